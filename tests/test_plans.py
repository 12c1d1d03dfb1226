"""Plans are what they should be: no Cartesian products, filters and columns at the scan, top-k without a full sort."""

import pytest
from pyspark.sql import functions as F

from mnemolake import schemas as S
from mnemolake.plans import adapters as A
from mnemolake.plans import load

SF = "/root/testdata/sf0.001"
QUERIES, _ = load()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["jn_hop1", "jn_supersede", "jn_window_rng", "jn_pairwise", "se_hybrid", "se_entity", "tk_ego", "co_reconcile", "st_prune", "ag_budget"])
def test_no_cartesian_product(spark, name):
    assert "CartesianProduct" not in plan(QUERIES[name](spark, SF))


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(A.session_events(spark, SF).where("role = 'user'").select("id"))
    assert "PushedFilters: [IsNotNull(role), EqualTo(role,user)]" in text and "text" not in text.split("ReadSchema: ")[1]


@pytest.mark.parametrize("name", ["tk_key_facts", "tk_recent", "tk_edges", "flt_asof_read", "tk_visible"])
def test_top_k_needs_no_full_sort(spark, name):
    assert "TakeOrderedAndProject" in plan(QUERIES[name](spark, SF))


def test_ranks_are_cut_before_the_exchange(spark):
    assert "WindowGroupLimit" in plan(QUERIES["wn_tail"](spark, SF))


def test_links_are_made_distinct_once(spark):
    """What groups links by itself gets them as they are read."""
    assert "Aggregate" not in plan(A.mentions(spark, SF)) and A.mentions(spark, SF).distinct().count() == A.fact_entities(spark, SF).count()
    assert plan(QUERIES["ag_subject_flag"](spark, SF)).count("keys=[l_orderkey") == 0


@pytest.mark.parametrize("name", ["se_context", "jn_hop1", "tk_ego", "in_ego", "tk_relatedness", "jn_edges_of", "ag_shared"])
def test_edges_are_made_at_centers(spark, name):
    """Pairs of other entities aren't made: lines aren't grouped for it."""
    assert plan(QUERIES[name](spark, SF)).count("keys=[l_orderkey") == 0


@pytest.mark.parametrize("name", ["co_run", "co_counts"])
def test_a_run_decides_once(spark, name):
    """What a run gives comes from the table of its decisions, not from facts that are judged again for it."""
    text = plan(QUERIES[name](spark, SF))
    assert "decisions-" in text and "documents.parquet" not in text


@pytest.mark.parametrize("name", ["fn_quality", "se_attach", "se_hybrid"])
def test_vectors_are_searched_exactly_at_any_size(spark, monkeypatch, name):
    """Also above the size from which a graph would be in order, as the SQL has no such switch."""
    monkeypatch.setattr(S, "ANN_BYTES", 0)
    text = plan(QUERIES[name](spark, SF))
    assert "CoGroup" not in text and "MapInArrow" in text


def test_facts_of_other_domains_are_left_out_as_they_are_read(spark):
    """Below the joins of facts, so that their texts aren't shuffled."""
    from mnemolake.operators import consolidate as C

    staged = A.session_facts(spark, SF).withColumn("domain", F.col("domain_hint"))
    text = C.reconciled(staged, A.facts(spark, SF), A.now())._jdf.queryExecution().optimizedPlan().toString()
    semi = next(i for i, line in enumerate(text.split("\n")) if "LeftSemi" in line)
    depth = [len(line) - len(line.lstrip(" :+-")) for line in text.split("\n")]
    assert any("Join LeftOuter" in line or "Join Inner" in line for line in text.split("\n")[:semi]) and depth[semi] > 3
    below = text.split("\n")[semi + 1 : semi + 4]
    assert any("text#" in line for line in below) and not any("Join" in line for line in below)
