"""Queries whose tables are dealt by key to partitions in proportion to their rows, as larger ones are."""

import re

import pytest

from carepath.operators import relational
from carepath.plans.analogue import Frames
from carepath.plans.registry import ORACLE, QUERIES

from .test_registry import duck, norm  # noqa: F401


@pytest.fixture
def small_tasks(monkeypatch):
    monkeypatch.setattr(relational, "TASK_ROWS", 500)  # 6,000 line items


def test_partitions_grow_with_the_rows(spark, sf_dir, small_tasks):
    t = Frames(spark, sf_dir)
    assert t.claims.rdd.getNumPartitions() == t.parts == -(-t.table("lineitem").count() // 500) > 4
    assert relational.parts_of(2_000) is None and relational.parts_of(2_001) == 5


@pytest.mark.parametrize("name", [
    "patient_latest_status", "patterns_first_second_line", "treatment_patterns_category", "treatment_timeline", "patient_list_page", "patient_rows",
    "patient_rows_enriched", "patient_detail_text", "fact_response_assessment", "patient_detail_nested",
])
def test_large_tables_give_the_same_rows(spark, sf_dir, duck, small_tasks, name):  # noqa: F811
    df = QUERIES[name](spark, sf_dir)
    cur = duck.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    cols = sorted(df.columns)
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr) == want


def test_timeline_is_shuffled_by_patient_only(spark, sf_dir, capsys):
    QUERIES["treatment_timeline"](spark, sf_dir).explain()
    assert "hashpartitioning(episode_id" not in capsys.readouterr().out


def test_asof_sides_dealt_alike_are_not_shuffled_again(spark, sf_dir, small_tasks, capsys):
    Frames(spark, sf_dir).responses.explain()
    assert set(re.findall(r"hashpartitioning\(patient_id#\d+L?, \d+\), (\w+)", capsys.readouterr().out)) == {"REPARTITION_BY_NUM"}
