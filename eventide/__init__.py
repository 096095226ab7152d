"""eventide: Spark jobs and DataFrame operators for "who did what to whom" event data.

Sub-packages:

* ``sources``   scans and sinks (positional TSV exports, zipped exports, interval
  logs, model state, prices, SPARQL bindings, article files, backfills)
* ``functions`` column-level helpers (time formats, NA tokens, whole-word regex)
* ``operators`` set-based operators (baselines, detection, graph, conflict, triples,
  mentions, price fusion, briefing, top-k)
* ``plans``     projections of the driver tables, the query catalogue and its SQL oracle
* ``streaming`` Structured Streaming twins of the batch jobs
"""

__all__ = ["session"]
