"""All registered queries: name -> callable(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from sitelens.plans import answers, audit, events, pages, texts


def queries() -> dict:
    out = {}
    out.update(pages.QUERIES)
    out.update(texts.QUERIES)
    out.update(answers.QUERIES)
    out.update(events.QUERIES)
    out.update(audit.QUERIES)
    return out
