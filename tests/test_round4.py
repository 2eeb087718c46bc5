"""Findings of round 4: lines without words, and what is shuffled, written or worked out again for each use."""

import time

import numpy as np
import pandas as pd

from quire.operators import gutters, pages, rules, spacing, vocabulary
from quire.plans import page_queries, queries, region_queries, table_queries
from tests.test_round3 import no_broadcast

SF = "/root/testdata/sf0.001"
LINES = "doc_id long, line_no int, text string"


def test_token_pairs_of_lines_without_words(spark):
    lines = spark.createDataFrame([(1, 0, "a b"), (1, 1, ""), (1, 2, " ... "), (1, 3, "x"), (2, 0, "a b"), (2, 1, None)], LINES)
    assert [tuple(r) for r in vocabulary.token_pairs(lines).collect()] == [("a", "b", 2)]


def test_joined_evidence_of_lines_without_words(spark):
    lines = spark.createDataFrame([(1, 0, "in form inform"), (1, 1, ""), (1, 2, "..."), (2, 0, "form")], LINES)
    assert [tuple(r) for r in vocabulary.joined_evidence(lines).collect()] == [("in", "form", 1, 1)]


def dealt_again(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("ENSURE_REQUIREMENTS")


def test_words_of_columns_are_dealt_out_once(spark):
    with no_broadcast(spark):
        glyphs, rows, pages = table_queries._columned(spark, SF)
        kept = gutters.body_rows(rows, pages)
        assert dealt_again(gutters.ink_stretches(glyphs, kept)) == 0
        assert dealt_again(gutters.wide_gaps(glyphs, kept)) == 0
    # other queries of the session join as before
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_words_that_meet_gutters_are_dealt_out_once(spark):
    with no_broadcast(spark):
        glyphs, rows, pages = table_queries._columned(spark, SF)
        cuts = pages.select("doc_id", "page", *((pages.page_w * k).alias(c) for c, k in (("low", 0.4), ("high", 0.5), ("cut", 0.45))))
        assert dealt_again(gutters.rows_across(glyphs, rows, cuts)) == 0


def test_readings_and_their_bases_meet_where_their_document_is(spark):
    with no_broadcast(spark):
        assert dealt_again(region_queries.with_readings(spark, SF)) == 0


def test_readings_are_translated_by_the_line(spark):
    with no_broadcast(spark):
        plan = region_queries.readings(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "translate(w" not in plan and "split(translate(text" in plan


def test_page_tables_need_one_pass_over_pages(spark):
    with no_broadcast(spark):
        df = table_queries.page_tables(spark, SF)
        assert dealt_again(df) == 0
        assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_line_box_tables_need_one_pass_over_pages(spark):
    with no_broadcast(spark):
        assert dealt_again(table_queries.line_box_tables(spark, SF)) == 0


def test_what_meets_is_found_piece_by_piece(monkeypatch):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 5, 60), rng.integers(0, 6, 80)
    test = lambda i, j: (i + j) % 3 == 0
    expected = sorted((i, j) for i in range(60) for j in range(80) if a[i] == b[j] and (i + j) % 3 == 0)
    for most in (1, 7, 2_000_000):
        monkeypatch.setattr(rules, "PAIRS", most)
        assert sorted(zip(*(x.tolist() for x in rules.meet(a, b, test)))) == expected


def test_rule_groups_need_one_pass_over_pages(spark):
    with no_broadcast(spark):
        assert dealt_again(table_queries.rule_groups(spark, SF)) == 0


def test_rules_in_a_long_chain_are_one_group():
    n, order = 3000, np.random.default_rng(2).permutation(3000)
    s = pd.DataFrame({"pg": 0, "seg": order, "b_x0": np.arange(n) * 10.0, "b_x1": np.arange(n) * 10.0 + 9, "b_y0": 0.0, "b_y1": 2.0}).sort_values("seg", ignore_index=True)
    other = s.assign(pg=1, b_x0=s["b_x0"] * 9, b_x1=s["b_x0"] * 9 + 9)
    got = rules.groups(pd.concat([s, other], ignore_index=True))
    assert (got[got["pg"] == 0]["table_id"] == 0).all() and (got[got["pg"] == 1]["table_id"] == got[got["pg"] == 1]["seg"]).all()


def test_a_line_of_many_open_gaps_takes_time_by_its_length(spark):
    text = "가나 " * 4000
    n = 8000
    info = [(0.05, 0.3, "p" if k % 2 else None) for k in range(n - 1)]
    df = spark.createDataFrame([(1, 0, text.strip(), info), (1, 1, "나가 가나 나가", [(0.0, 0.1, None)] * 2), (1, 2, None, [])], "doc_id long, line_no int, text string, info array<struct<p:double,g:double,src:string>>")
    began = time.time()
    got = {r.line_no: (r.text, r.n_changed) for r in spacing.refined_spacing(df).collect()}
    assert time.time() - began < 20
    assert got == {0: (text.strip(), 0), 1: ("나가 가나 나가", 0), 2: (None, 0)}


def test_cells_are_counted_where_their_document_is(spark):
    with no_broadcast(spark):
        assert dealt_again(queries.column_gutters(spark, SF)) == 0


def test_dot_leaders_look_at_all_lines_of_a_batch_at_once(spark):
    glyph = lambda i, c, font="g", x=None: (i, c, 5.0 * i if x is None else x, 5.0 * i + 4 if x is None else x + 4, 10.0, font)
    texts = {1: "a???", 2: "??1", 3: "??a", 4: "", 5: "???"}
    rows = [(1, k, [glyph(i, c) for i, c in enumerate(t)]) for k, t in texts.items()]
    rows += [(1, 6, [glyph(0, "?"), glyph(1, "?", "f"), glyph(2, "?", "f")]), (1, 7, [glyph(0, "?"), glyph(1, "?"), glyph(2, "?", x=40.0)]), (1, 8, [glyph(0, None), glyph(1, "?"), glyph(2, "?"), glyph(3, "1")]), (2, 9, None)]
    df = spark.createDataFrame(rows, "doc_id long, line_no int, glyphs array<struct<ci:int,c:string,x0:double,x1:double,size:double,font:string>>")
    got = pages.leader_runs(df, "?")
    assert "lambdafunction" not in page_queries.dot_leaders(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.line_no, r.ci) for r in got.collect()) == [(1, 1), (1, 2), (1, 3), (2, 0), (2, 1), (5, 0), (5, 1), (5, 2), (8, 1), (8, 2)]
