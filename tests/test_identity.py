"""What identity resolution shuffles, and its persons against those that a plain union of sets finds."""

import random

import pytest

from carepath.operators import identity
from carepath.plans.registry import QUERIES

PEOPLE = "source_system string, source_patient_id string, first_name string, last_name string, date_of_birth string, zip5 string"
SOUNDS = {"Robert": "R163", "Rupert": "R163", "Anna": "A500", None: None}


@pytest.fixture
def unbroadcast(spark):
    """Joins of large tables: none of them is broadcast."""
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    for name in names:
        spark.conf.set(name, "-1")
    yield
    for name in names:
        spark.conf.unset(name)


def shuffled(spark) -> int:
    """Bytes that the session has shuffled so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    executors = sc.statusStore().executorList(False)
    return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))


@pytest.mark.parametrize("name", ["dim_patient_two_loads", "identity_two_loads"])
def test_a_record_shuffles_little(spark, unbroadcast, name):
    sf_dir = "/root/testdata/sf0.01"  # 1,500 records
    before = shuffled(spark)
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    assert shuffled(spark) - before < 4_000 * 1_500


def persons(rows):
    """The sets of records, by source and id, that keys of `rows` connect."""
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for system, number, first, last, born, zip5 in rows:
        own = (system, number)
        if last and born and zip5:
            parent[root(own)] = root(("exact", last.upper(), born, zip5))
        if last and born and first:
            parent[root(own)] = root(("sound", SOUNDS[first], last.upper(), born))
    sets = {}
    for own in {r[:2] for r in rows}:
        sets.setdefault(root(own), set()).add(own)
    return sorted(sorted(s) for s in sets.values())


def by_person(ids):
    sets = {}
    for own, person in ids.items():
        sets.setdefault(person, set()).add(own)
    return sorted(sorted(s) for s in sets.values())


def people(seed, n, ids):
    at = random.Random(seed)
    pick = at.choice
    return [(pick(["EHR", "CLAIMS"]), str(at.randrange(ids)), pick(list(SOUNDS)), pick(["Lee", "LEE", "Ray", None]), f"19{at.randrange(50):02}-01-01", pick([None, *map(str, range(12))])) for _ in range(n)]


def test_resolve_finds_the_persons_that_keys_connect(spark, unbroadcast):
    rows = people(1, 300, 200)  # some records come twice, with other values
    got = identity.resolve(spark.createDataFrame(rows, PEOPLE)).collect()
    assert len(got) == len(rows)
    ids = {(r.source_system, r.source_patient_id): r.patient_id for r in got}
    assert len({(r.source_system, r.source_patient_id, r.patient_id) for r in got}) == len(ids)
    assert by_person(ids) == persons(rows)


def test_loads_find_the_persons_that_all_keys_connect(spark, unbroadcast):
    loads = [people(2, 120, 400), people(3, 120, 400), []]
    loads[2] = [*people(4, 60, 400), *loads[0][:20]]
    keys, redirects = identity.no_keys(spark), identity.no_redirects(spark)
    records, seen = None, []
    for number, rows in enumerate(loads, 1):
        out = identity.link(spark.createDataFrame(rows, PEOPLE), keys, redirects, number)
        keys = spark.createDataFrame(keys.unionByName(out.keys).collect(), identity.KEYS)
        redirects = spark.createDataFrame(identity.add_redirects(redirects, out.redirects).collect(), identity.REDIRECTS)
        records = spark.createDataFrame((out.records if records is None else records.unionByName(out.records)).collect(), out.records.schema)
        seen += rows
        ids = {(r.source_system, r.source_patient_id): r.patient_id for r in identity.current_ids(records, redirects).collect()}
        assert by_person(ids) == persons(seen)
        assert keys.count() == keys.select("key").distinct().count()


def test_one_key_of_many_records_is_one_person(spark, unbroadcast):
    rows = [("EHR", str(k), "Anna", "Lee", "1950-01-01", str(k % 7)) for k in range(3_000)]
    got = identity.resolve(spark.createDataFrame(rows, PEOPLE)).select("patient_id", "source_patient_id")
    assert got.count() == 3_000 and got.select("patient_id").distinct().count() == 1
