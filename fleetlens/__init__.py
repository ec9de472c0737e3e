"""fleetlens: operations-log, fleet-audit and review-queue analytics on Spark.

Every report is a plain function ``DataFrame(s) -> DataFrame`` built on the public
DataFrame API, so the same code runs on one log file or on the logs of thousands of
hosts.  Sub-packages:

* ``sources``   - line scans, file listings, CSV / JSON readers, parsers, report sink
* ``functions`` - column-level helpers (awk/cut field access, text normalisation)
* ``operators`` - the reports (traffic, watchdog, fleet logs, fleet tables, review queue)
* ``plans``     - test-input renderers and the registered query set
* ``streaming`` - the same reports over a text stream
"""

__version__ = "0.1.0"
