"""All registered queries: name -> (Spark plan, reference SQL or None)."""

from __future__ import annotations

from telemill.plans import alert_queries, log_queries, metric_queries, row_queries, store_queries, stream_queries, trace_queries

REGISTERED = {
    **trace_queries.QUERIES,
    **log_queries.QUERIES,
    **metric_queries.QUERIES,
    **row_queries.QUERIES,
    **alert_queries.QUERIES,
    **stream_queries.QUERIES,
    **store_queries.QUERIES,
}
