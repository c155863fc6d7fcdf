"""cadenza: playlist and listening-profile analytics as Spark DataFrame jobs.

Every job takes DataFrames and returns DataFrames; nothing is collected to
the driver.  Sub-packages:

- ``sources``   reading the driver tables and deriving the domain tables
- ``functions`` column expressions (year parsing, JSON typing, formatting)
- ``operators`` the jobs (candidate selection, profiles, store, reports, ...)
- ``plans``     registered query plans and plan inspection helpers
- ``streaming`` Structured Streaming ingest and refresh jobs
"""

from cadenza.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
