"""Fixed row types of the documents the sources read."""

DELIVERABLE = "struct<task_key: string, name: string, path: string, bytes: bigint>"
TASK = (
    "struct<key: string, engine: string, model: string, status: string, attempt: int, "
    "tokens: bigint, verified: string, log_path: string, started_at: string, ended_at: string, "
    f"deliverables: array<{DELIVERABLE}>, check_tail: string, deliverable_notes: array<string>>"
)
RUN_STATE = (
    "run_id string, run_name string, identity string, pid int, started_at string, "
    f"updated_at string, done boolean, tasks array<{TASK}>"
)
ACTIVE_RUN = (
    "struct<pid: int, run_name: string, identity: string, workdir: string, started_at: string>"
)
MANIFEST_TASK = (
    "struct<key: string, spec: string, `check`: string, engine: string, model: string, "
    "expect_files: array<string>, timeout_s: int, full_access: boolean, "
    "engine_args: array<string>, verified: string, task_type: string>"
)
MANIFEST = (
    "run_name string, workdir string, max_parallel int, worktrees boolean, repo string, "
    f"tasks array<{MANIFEST_TASK}>"
)
