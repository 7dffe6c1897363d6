"""Published metrics, scored again from published predictions.

FORMULARY_PUBLISHED names a folder with a folder a split: manifest.jsonl (id, domain, target_text,
spoken_transcript), predictions.jsonl (id, one field a system), views.json (view, system, whether its
predictions go through the rules) and metrics.json (by view, and per_domain_exact). Without it the
tests are skipped.
"""

import json
import os
from pathlib import Path

import pytest

from formulary.plans.evaluation import evaluated

FILES = Path(os.environ.get("FORMULARY_PUBLISHED", "/nowhere"))
SPLITS = sorted(p.name for p in FILES.iterdir() if p.is_dir()) if FILES.exists() else []


def lines(path):
    return [json.loads(x) for x in path.read_text(encoding="utf-8").splitlines() if x.strip()]


@pytest.mark.skipif(not SPLITS, reason="no published files")
@pytest.mark.parametrize("split", SPLITS or ["none"])
def test_published_metrics(spark, split):
    here = FILES / split
    want, views = json.loads((here / "metrics.json").read_text()), [tuple(v) for v in json.loads((here / "views.json").read_text())]
    systems = sorted({system for _, system, _ in views})
    predictions = spark.createDataFrame([(r["id"], *(r.get(s) for s in systems)) for r in lines(here / "predictions.jsonl")], "id string, " + ", ".join(f"{s} string" for s in systems))
    fields = ("id", "domain", "target_text", "spoken_transcript")
    clips = spark.createDataFrame([(split, *(r[f] for f in fields)) for r in lines(here / "manifest.jsonl")], "split string, " + ", ".join(f"{f} string" for f in fields))
    out = evaluated(predictions, clips, views)
    got = {r["view"]: r.asDict() for r in out["metrics"].collect()}
    assert set(got) == {v for v, _, _ in views}
    off = {}
    for view in got:
        for metric, value in want[view].items():
            mine = got[view][metric]
            if (mine is None) != (value is None) or (value is not None and abs(mine - value) > 1e-9):
                off[view, metric] = (mine, value)
    assert not off
    domains = {r["domain"]: r.asDict() for r in out["domains"].collect()}
    for domain, values in want["per_domain_exact"].items():
        assert all(domains[domain][name] == pytest.approx(value) for name, value in values.items())
