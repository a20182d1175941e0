"""runledger: the data side of running batch pipelines, on Spark.

* ``runledger.sources``   table scans, JSON configuration, control files, file listings
* ``runledger.functions`` scalar Column functions, column encryption
* ``runledger.operators`` checks, configuration routing, holiday calendar, the run
  ledger and its sinks, success markers, copy reconciliation
* ``runledger.streaming`` the ledger as a stream
* ``runledger.plans``     join strategy helpers, test fixtures, the query catalogue
* ``runledger.dropin``    the original per-job call shapes on top of the operators

Every operator takes DataFrames and returns a DataFrame built from built-in
Spark SQL functions; only sinks and ``assert_*`` helpers run actions.
"""

__version__ = "0.1.0"
