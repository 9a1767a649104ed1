"""All registered queries of the web-clip pipelines."""

from __future__ import annotations

from pagemill.plans import assembly, clips, imagery, labels, pages, records, state, web

QUERIES = {**web.QUERIES, **state.QUERIES, **pages.QUERIES, **labels.QUERIES, **assembly.QUERIES, **clips.QUERIES, **imagery.QUERIES, **records.QUERIES}
ORACLES = {**web.ORACLES, **state.ORACLES, **pages.ORACLES, **labels.ORACLES, **assembly.ORACLES, **clips.ORACLES, **imagery.ORACLES, **records.ORACLES}
