"""Piles of reads: placed once, in the shared folder; what follows makes no words and broadcasts none."""

from strandloom.operators import mapping
from strandloom.registry import QUERIES


def test_pile_up_makes_no_words_again(spark):
    assert "MapInArrow" not in QUERIES["pile_up"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_contact_breaks_place_reads_once(spark, monkeypatch):
    calls, real = [], mapping.placed_once
    monkeypatch.setattr(mapping, "placed_once", lambda votes: calls.append(1) or real(votes))
    QUERIES["contact_breaks"](spark, "/root/testdata/sf0.001")
    assert len(calls) == 1
