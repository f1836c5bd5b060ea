"""Attestry: Spark jobs for evaluation logs, price catalogs, run states and contracts.

Every public operator takes DataFrames and returns a DataFrame; nothing here
runs an action on its own except the sinks in ``sources`` and the streaming
writers in ``streaming``.
"""

__version__ = "0.1.0"
