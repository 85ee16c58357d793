"""vitrine — retail-channel analytics as Spark DataFrame operators.

Every operator is a function ``(DataFrame(s), parameters) -> DataFrame``;
none reads the wall clock (the reporting date ``as_of`` and the run time
``run_ts`` are parameters), and IO lives only in ``vitrine.sources.tables``
and ``vitrine.streaming``.

Modules: ``functions.values`` (JSON value rules), ``sources`` (feeds,
bindings, landed pages, tables), ``operators`` (normalise, latest-wins,
staging, marts, reads, cards, quality, rules, ops, redaction), ``streaming``
(ingest and incremental marts), ``plans`` (stage graph, rebuild, registered
queries and their SQL oracle), ``session`` (settings and sizing).
"""

__all__ = ["session"]
