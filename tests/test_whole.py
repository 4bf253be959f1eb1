"""Queries over small tables of their own, against plain formulations over all rows."""

import datetime
import itertools
import math
import statistics

import pytest

from tidemark import registry
from tidemark.plans import portable
from tidemark.sources.tables import run_sql

ORDERS = "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string"
LINES = "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_extendedprice double, l_discount double"


@pytest.fixture
def folder(spark, tmp_path):
    """Writes tables (name: rows, schema) and runs a query over them."""

    def run(name, tables, **bounds):
        for table, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
        return registry.queries()[name](spark, str(tmp_path), **bounds).collect()

    return run


def series(prices, discount=lambda nation, at: 0.0):
    """Tables with one order a quarter: {nation: {quarters since 1990: price, or a list of prices of as many orders}}."""
    orders, lines = [], []
    for nation, quarters in prices.items():
        for at, price in quarters.items():
            for one in price if isinstance(price, list) else [price]:
                orders.append((len(orders), nation, datetime.datetime(1990 + at // 4, at % 4 * 3 + 2, 1), "LOW"))
                lines.append((len(lines), 1, 1, float(at), float(one), discount(nation, at)))
    return {
        "region": ([(0, "R")], "r_regionkey long, r_name string"),
        "nation": ([(n, f"N{n}", 0) for n in prices], "n_nationkey long, n_name string, n_regionkey long"),
        "customer": ([(n, n, f"C{n}") for n in prices], "c_custkey long, c_nationkey long, c_name string"),
        "orders": (orders, ORDERS),
        "lineitem": (lines, LINES),
    }


def test_repetition_cosine_keeps_parts_apart(folder):
    # parts 500 apart are different parts
    sets = {0: {1, 2, 3, 1002}, 1: {1, 502, 503}, 2: {501, 1001, 2, 3}, 3: {7}}
    lines = [(nation, part) for nation, parts in sets.items() for part in sorted(parts) + [min(parts)]]
    rows = folder("repetition_cosine", {
        "customer": ([(n, n) for n in sets], "c_custkey long, c_nationkey long"),
        "orders": ([(n, n) for n in sets], "o_orderkey long, o_custkey long"),
        "lineitem": (lines, "l_orderkey long, l_partkey long"),
    })
    want = {(a, b): round(len(sets[a] & sets[b]) / math.sqrt(len(sets[a]) * len(sets[b])), 6) for a, b in itertools.combinations(sets, 2) if sets[a] & sets[b]}
    assert {(r["left_segment"], r["right_segment"]): r["cosine"] for r in rows} == want


def test_metric_history_has_no_bounds_of_its_own(folder):
    tables = series({1: {at: 1_000_000 + at for at in range(0, 60, 3)}})
    assert sorted(r["slot"] for r in folder("metric_history", tables)) == [7960 + at for at in range(0, 60, 3)]
    assert sorted(r["slot"] for r in folder("metric_history", {}, since=7963, until=7969)) == [7963, 7966, 7969]
    assert sorted(r["slot"] for r in folder("metric_history", {}, until=7963)) == [7960, 7963]


def test_fact_evidence_of_every_line(folder):
    tables = series({1: {at: 5 for at in range(60)}, 2: {7: 5}})
    rows = folder("fact_evidence", tables)
    assert sorted((r["l_orderkey"], r["n_name"], r["r_name"]) for r in rows) == [(k, "N1" if k < 60 else "N2", "R") for k in range(61)]


def test_reversing_steps_fire_as_moves(folder):
    # N1 reverses by steps of over its sigma that are small for the metric; N2 has one reversal that also fires
    small = [50_000_000 + 1000 * x for x in (0, 100, 200, -200, -300, -400, 100, 200, 300, -100, -200)]
    large = [1_000_000 * x for x in (50, 70, 50, 70, 50, 70, 50, 52, 75, 45, 70, 50, 70)]
    rows = folder("trend_reversal", series({1: dict(enumerate(small)), 2: dict(enumerate(large))}))
    assert [(r["subject"], r["slot"]) for r in rows] == [("N2", 7960 + 9)]


def test_divergence_of_two_canonical_metrics(folder):
    nation, last = 4, 48
    discount = lambda _, at: 0.5 if at in (7, 29) else 0.02 + at * 7 % 5 / 100
    price = {at: 50_000_000 + 130_000 * (at * 5 % 11) for at in range(last)}
    gaps, lost, tolerance = {}, set(), 1000
    for at in range(last):
        year, quarter = 1990 + at // 4, at % 4 + 1
        if (nation + quarter) % 5 == 0 and (nation + quarter + year) % 7 == 0:  # two readings against two
            lost.add(at)
        else:
            gaps[at] = 1000 * (round(price[at] / 1000) - round(price[at] * (1 - discount(0, at)) / 1000))
    formula = {at: 1 if at < 32 else 3 if 41 <= at <= 43 else 2 for at in gaps}
    want = {}
    for at, gap in gaps.items():
        near = [g for b, g in gaps.items() if formula[b] == formula[at]]
        rest = [g for b, g in gaps.items() if formula[b] == formula[at] and b != at]
        if len(near) >= 8 and statistics.pstdev(near) >= 2 * tolerance and statistics.pstdev(rest) >= 2 * tolerance:
            z = (gap - statistics.fmean(near)) / statistics.pstdev(near)
            if abs(z) >= 1.5:
                want[7960 + at] = (gap, round(z, 4), len(near), len(gaps) - len(near), len(lost))
    rows = folder("cross_metric_divergence", series({nation: price}, discount))
    assert lost and 7967 in want
    assert {r["slot"]: (r["gap"], r["z"], r["n_population"], r["n_excluded"], r["n_unresolved"]) for r in rows} == want
    assert not folder("cross_metric_divergence", series({nation: price}, lambda _, at: 0.5 if at == 7 else 0.02 / (price[at] / 1e6)))  # one excursion is no spread


def test_candidates_of_short_series_and_of_all_detectors_are_scored(folder, spark, tmp_path, monkeypatch):
    prices = {
        1: {0: 50_000_000, 1: 100_000_000},
        6: dict(enumerate(1_000_000 * x for x in (50, 51, 52, 53, 99, 98))),
        4: dict(enumerate(1_000_000 * x for x in (50, 70, 50, 70, 50, 70, 50, 52, 75, 45, 70, 50, 70, 69, 68, 60, 30, 50, 51, 50, 52, 51, 50, 52))),
    }
    found = {r["candidate_id"]: r for r in folder("candidate_scores", series(prices, lambda nation, at: 0.5 if at == 7 else 0.02 + at * 7 % 5 / 100))}
    assert {r["detector"] for r in found.values()} == {"metric_move", "trend_reversal", "acceleration", "cross_metric_divergence"}
    one, some = found["metric_move:N1:7961"], found["metric_move:N6:7964"]
    assert one["z"] is None and one["units"] is None and (one["n_docs"], one["n_warnings"]) == (2, 0)
    assert one["score"] == pytest.approx(0.15 * 2 / 5 + 0.10)
    assert some["z"] is None and some["units"] >= 1
    gap = next(r for r in found.values() if r["detector"] == "cross_metric_divergence")
    assert gap["z"] >= 1.5 and gap["units"] is None
    ranked = folder("ranked_candidates", {})
    assert sorted(r["place"] for r in ranked) == list(range(1, len(found) + 1)) and {r["candidate_id"] for r in ranked} == set(found)
    # a minority of readings in an anchor is a warning
    minority = lambda nation, slot: ((nation + slot % 4 + 1) % 5 == 0) != ((nation + slot % 4 + 1 + slot // 4) % 7 == 0)
    moves = [r for r in found.values() if r["detector"] == "metric_move"]
    assert {r["n_warnings"] for r in moves} == {0, 1}
    assert all(r["n_warnings"] == any(minority(int(r["subject"][1:]), slot) for slot in (r["slot"] - 1, r["slot"])) for r in moves)
    # one accepted post that shares three of the four items of N1's move
    monkeypatch.setitem(portable.PARTS, "accepted_item", "SELECT * FROM (VALUES ('a', 'type:metric_move'), ('a', 'metric:N1:revenue'), ('a', 'period:1990Q2'), ('b', 'period:1990Q1')) AS a(post, item)")
    again = {r["candidate_id"]: r for r in run_sql(spark, str(tmp_path), portable.compose(portable.QUERIES["candidate_scores"])).collect()}
    assert again["metric_move:N1:7961"]["score"] == pytest.approx(0.16 - 0.25 * 3 / math.sqrt(12), abs=1e-6)
