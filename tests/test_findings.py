"""What reviewers found on odd inputs and on larger tables."""

import difflib
import random

import duckdb

from dossier.functions import extract
from dossier.operators import datasets, entities, references
from dossier.plans import archive, network, queries, records
from tests.test_flows import dataset, given

SQL = archive.oracle_sql(records, network)


def by_sql(sql, directory, *names):
    con = duckdb.connect()
    for t in names:
        con.execute(f"create view {t} as from '{directory}/{t}.parquet/*.parquet'")
    return sorted(con.execute(sql).fetchall())


def test_normalised_as_its_sql_says(spark, tmp_path):
    """ß has one capital letter in SQL."""
    rows = [(1, " Straße  é ñ\n", "fr"), (2, None, "fr"), (3, "x" * 58 + "ßßß", "fr")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, queries.queries()["n1_normalize"](spark, str(tmp_path)).collect()))
    assert got == by_sql(queries.oracle_sql()["n1_normalize"], tmp_path, "documents")


def test_archive_of_long_keys(spark, tmp_path):
    """Keys of six digits share the five that a name has room for."""
    rows = [(k, "name", "type", 7) for k in (5, 100_002, 100_003, 100_005)]
    spark.createDataFrame(rows, "p_partkey bigint, p_name string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    want = by_sql(SQL["s7_archive"], tmp_path, "part")
    assert sorted(map(tuple, records.s7_archive(spark, str(tmp_path)).collect())) == want and len(want) == 3


def test_every_even_order_is_tied(spark, tmp_path):
    """Fifths of the orders had an amount of zero, so that nothing came of them."""
    spark.createDataFrame([(o, 1, 2.5) for o in (1, 2, 4, 10)], "o_orderkey bigint, o_custkey bigint, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    lines = [(o, n, s, "N") for o in (1, 2, 4, 10) for n, s in ((1, 1), (3, 2))]
    spark.createDataFrame(lines, "l_orderkey bigint, l_linenumber int, l_suppkey bigint, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = sorted(map(tuple, network.m6_undirected(spark, str(tmp_path)).collect()))
    assert got == [(2, "s1", "s2", 250), (4, "s1", "s2", 250), (10, "s1", "s2", 250)] == by_sql(SQL["m6_undirected"], tmp_path, "orders", "lineitem")


def test_alias_candidates_are_few_and_none_is_lost(spark):
    """Names of random letters, half of them altered copies of others: every pair that is alike is compared, and few others are."""
    rnd, names = random.Random(5), set()
    letters = lambda n: "".join(rnd.choices("BCDFGHJKLMNPQRTV", k=n))
    while len(names) < 400:
        name = letters(rnd.randint(12, 40))
        names.add(name)
        for _ in range(rnd.randint(1, 5)):
            at, gone = rnd.randrange(len(name)), rnd.randint(0, 1)
            name = name[:at] + letters(rnd.randint(0, 2)) + name[at + gone :]
        names.add(name)
    names = sorted(x for x in names if len(x) >= 12)
    df = spark.createDataFrame([(i, x, len(x)) for i, x in enumerate(names)], "id bigint, norm string, len int")
    found = {(r.a, r.b) for r in entities._share_a_piece(df, 0.9).collect()}
    ratio = lambda x, y: difflib.SequenceMatcher(None, x, y).ratio()
    want = {(i, j) for i, x in enumerate(names) for j, y in enumerate(names) if i < j and min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and ratio(x, y) >= 0.9}
    assert len(want) > 50 and want <= found and len(found) < 2 * len(names)


def test_files_of_a_load_dont_grow_with_its_sources(spark, tmp_path):
    """A folder for each source made a file for each source and table."""
    datasets.load(*given(spark, *((f"d{k}", dataset(str(k))) for k in range(40))), f"file://{tmp_path}/fluxos")
    assert all(len(list((tmp_path / "fluxos" / n).rglob("*.parquet"))) <= 8 for n in datasets.TABLES)
    assert datasets.tables(spark, f"file://{tmp_path}/fluxos", spark.createDataFrame([], "chave string"))["fontes"].count() == 40


def test_masks_ask_for_a_digit_before_they_look_back():
    """Looking back from each character made pages slow to mask."""
    assert extract.UNREGISTERED.startswith(r"(?=\d)")


def test_sheets_keep_the_sign_of_zero(spark, tmp_path):
    """A balance of -0.0, or one that rounds to it, is printed as -0.00; whole cents had lost the sign."""
    balances = [0.0, -0.0, -0.004, 0.004, -0.01, 0.125, 0.375, -999.99, 9999.99, None]
    put = lambda rows, kinds, name: spark.createDataFrame(rows, kinds).write.parquet(str(tmp_path / f"{name}.parquet"))
    put([(i, x, "S", "P") for i, x in enumerate(balances)], "o_orderkey bigint, o_totalprice double, o_orderstatus string, o_orderpriority string", "orders")
    put([(i, x, "M", 1, "C") for i, x in enumerate(balances)], "c_custkey bigint, c_acctbal double, c_mktsegment string, c_nationkey int, c_name string", "customer")
    put([(i, x, 1) for i, x in enumerate(balances)], "s_suppkey bigint, s_acctbal double, s_nationkey int", "supplier")
    put([(1, "B", 2, "N")], "p_partkey bigint, p_brand string, p_size int, p_name string", "part")
    blank = lambda r: tuple("" if x is None else x for x in r)

    def given_by(name):
        con = duckdb.connect()
        for t in ("orders", "customer", "supplier", "part"):
            con.execute(f"create view {t} as from '{tmp_path}/{t}.parquet/*.parquet'")
        return con.execute(SQL[name]).fetchall()

    assert sorted(blank(r) for r in records.s10_four_sheets(spark, str(tmp_path)).collect()) == sorted(map(blank, given_by("s10_four_sheets")))
    assert sorted(map(blank, records.s10_flow_sheets(spark, str(tmp_path)).collect())) == sorted(map(blank, given_by("s10_flow_sheets")))


def test_citations_without_quotes(spark):
    """The same citations, but no places and quotes are worked out where nobody asks for them; a statute's documents aren't gathered in a row."""
    text = "Vide Pet 16.669, Inq nº 5026, PET 2024 e xHC 123.456; arts. 319, 320-A e 7º do cpp, não do CP; art. 5º da Lei 6.385/76 e ARE 1.001. Art. 9 de nada"
    pages = spark.createDataFrame([(1, 1, text), (1, 2, text * 3), (2, 1, "é art. 2 " + "x" * 89 + " CPP"), (3, 1, None)], "documento_id bigint, pagina int, texto string")
    for f in (references.cited_cases, references.cited_statutes):
        plain = f(pages, quotes=False)
        assert plain.columns == f(pages).drop("trecho").columns
        assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, f(pages).drop("trecho").collect())) and plain.count() > 4
    listed = references.statute_documents(references.cited_statutes(pages, quotes=False))
    assert "collect_list" not in listed._jdf.queryExecution().optimizedPlan().toString()
