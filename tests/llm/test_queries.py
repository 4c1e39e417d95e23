"""The registered queries of this folder, against their SQL where they have one."""

import pytest

import __spark_entry__ as contract
from check_oracles import compare, duck
from vigilog.llm.oracles import LLM_ORACLES
from vigilog.llm.queries import LLM

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", [n for n in LLM if n in LLM_ORACLES])
def test_query_equals_sql(spark, con, name):
    problem, _, _ = compare(spark, con, name, SF_DIR)
    assert problem is None


def test_all_are_registered():
    names = list(contract.queries())
    assert [n for n in names if n.startswith("op")] == list(LLM) and "pipeline" in names
    assert {n.split("_")[0] for n in LLM} == {f"op{k}" for k in range(1, 14)}


def test_rules_and_hosts_of_the_pages(spark, con):
    """The parts of the URL query that SQL can tell: all but the model's verdicts."""
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict if r.rule else None)
           for r in LLM["op8_url_filter"](spark, SF_DIR).collect()}
    sql = """
    WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    named AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS host, rest FROM cut),
    parts AS (SELECT page_id, lower(host) AS host, regexp_extract(substr(rest, length(host) + 1), '^[^?#]*') AS path FROM named),
    rules(says, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/'))
    SELECT a.page_id, host, path, arg_max(h || p, length(h || p)), arg_max(says, length(h || p))
    FROM parts a LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL"""
    assert got == set(con.execute(sql).fetchall())


@pytest.mark.parametrize("name", [n for n in LLM if n not in LLM_ORACLES])
def test_query_runs(spark, name):
    rows = LLM[name](spark, SF_DIR).collect()
    tables = {"op6_license_scan": None, "op7_html_text": "pages", "op8_url_filter": "pages", "op9_packing": None, "op12_graph_search": None}
    table = tables.get(name, "documents")
    if table:
        assert len(rows) == spark.read.parquet(f"{SF_DIR}/{table}.parquet").count()
    assert rows
