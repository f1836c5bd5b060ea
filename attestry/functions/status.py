"""Status, verdict and outcome ladders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestry.functions.values import nonblank

FAILED = ["failed", "timeout"]
KINDS = ["pass", "working", "retry", "fail", "waiting"]


def status_kind(status: Column, attempt: Column) -> Column:
    """Display bucket of a task; a second running attempt is a retry."""
    return (
        F.when(status == "passed", "pass")
        .when((status == "running") & (attempt > 1), "retry")
        .when(status == "running", "working")
        .when(status.isin(*FAILED), "fail")
        .otherwise("waiting")
    )


def attempt_verdict(timed_out: Column, spawn_error: Column, check_pass: Column) -> Column:
    """A timeout outranks a spawn error, which outranks the check."""
    return (
        F.when(timed_out, "TIMEOUT").when(spawn_error, "ERROR").when(check_pass, "PASS")
        .otherwise("FAIL")
    )


def verdict_status(verdict: Column) -> Column:
    return (
        F.when(verdict == "PASS", "passed").when(verdict == "TIMEOUT", "timeout").otherwise("failed")
    )


def status_verdict(status: Column) -> Column:
    return (
        F.when(status == "passed", "PASS").when(status == "timeout", "TIMEOUT")
        .when(status == "failed", "FAIL").otherwise("ERROR")
    )


def run_outcome(done: Column, failures: Column) -> Column:
    return F.when(~done, "live").when(failures > 0, "fail").otherwise("pass")


def run_state(done: Column, failures: Column, died: Column) -> Column:
    return F.when(died, "died").otherwise(run_outcome(done, failures))


def known_tokens(tokens: Column) -> Column:
    """Unknown counts are shown as a dash."""
    return F.when(tokens < 0, "-").otherwise(tokens.cast("string"))


# Fixed wording of the status page.
def empty_work_note(kind: Column) -> Column:
    return (
        F.when(kind == "pass", "Finished and checked — this worker filed nothing to the shelf.")
        .when(kind == "fail", "Failed its check — nothing was delivered.")
        .when(kind.isin("working", "retry"), "Nothing delivered yet — still on it.")
        .otherwise("Waiting its turn.")
    )


def kind_text(kind: Column) -> Column:
    return (
        F.when(kind == "pass", "finished & checked").when(kind == "working", "working")
        .when(kind == "retry", "sent back — redoing").when(kind == "fail", "failed")
        .otherwise("waiting")
    )


def settled(kind: Column) -> Column:
    """Proof is shown only for finished tasks, so a retry never shows the old one."""
    return kind.isin("pass", "fail")


def how_checked(kind: Column, verified: Column) -> Column:
    label = F.when(kind == "fail", "What the check demanded").otherwise("How it was checked")
    return F.when(settled(kind), F.concat(label, F.lit(": "), nonblank(verified)))


def proof(kind: Column, check_tail: Column) -> Column:
    return F.when(settled(kind), nonblank(check_tail))


def proof_label(kind: Column, check_tail: Column) -> Column:
    text = F.when(kind == "fail", "See why it failed").otherwise("See the proof")
    return F.when(proof(kind, check_tail).isNotNull(), text)
