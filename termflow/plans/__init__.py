from importlib import import_module

from .registry import QUERIES, Query

MODULES = ["text_queries", "term_queries", "library_queries", "glossary_queries", "source_queries", "segment_queries",
           "exchange_queries", "job_queries", "quality_queries", "stream_queries"]


def load_all() -> dict[str, Query]:
    for m in MODULES:  # noqa
        import_module(f"{__name__}.{m}")
    return dict(QUERIES)
