"""The registered queries: operators applied to the driver tables."""

from pricewren.workload.registry import ORACLES, QUERIES


def _load() -> None:
    from pricewren.workload import audits, extraction, files, matching, prices, serving, streams, texts, verdicts  # noqa: F401


def all_queries():
    _load()
    return dict(QUERIES)


def all_oracles():
    _load()
    return dict(ORACLES)
