import json

import pytest

from hopweave import PropertyGraph
from hopweave.sources import readers, sinks


def put(folder, **files):
    for name, text in files.items():
        p = folder / f"{name.replace('__', '/')}.csv"
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return str(folder)


def pairs(g, a, kind, b):
    return sorted(map(tuple, g.edges(a, kind, b).collect()))


def test_ldbc_bi(spark, tmp_path):
    d = put(tmp_path, Person__part_0="id|firstName|LocationCityId\n30|Zoë|1\n10|Al|2\n", Person__part_1="id|firstName|LocationCityId\n20|A name that is long|3\n", Person_knows_Person__part_0="creationDate|Person1Id|Person2Id\nx|10|30\nx|30|10\nx|20|20\n")
    g = readers.ldbc_bi(spark, d)
    people = {r.id: r.name for r in g.vertices("Person").collect()}
    assert people == {0: "Al", 1: "A name that is l", 2: "Zo"}
    assert pairs(g, "Person", "knows", "Person") == [(0, 2), (1, 1), (2, 0)]
    assert {r.community for r in g.vertices("Person").collect()} == {0}


def test_ldbc_ic(spark, tmp_path):
    d = put(tmp_path, person_0_0="id|firstName|place\n7|B|1\n5|A|2\n", person_knows_person_0_0="Person.id|Person.id|creationDate\n5|7|2010\n")
    g = readers.ldbc_ic(spark, d, dense=False)
    assert pairs(g, "Person", "knows", "Person") == [(5, 7), (7, 5)]


def test_snap(spark, tmp_path):
    (tmp_path / "g.txt").write_text("# comment\n1\t2\n\n 2   3\n1 2\n")
    (tmp_path / "g.csv").write_text("node_1,node_2\n4,9\n")
    g = readers.snap_txt(spark, str(tmp_path / "g.txt"))
    assert pairs(g, "Person", "knows", "Person") == [(0, 1), (1, 0), (1, 2), (2, 1)]
    assert all(len(r.name) == 16 and r.name.isalpha() for r in g.vertices("Person").collect())
    assert pairs(readers.snap_csv(spark, str(tmp_path / "g.csv")), "Person", "knows", "Person") == [(0, 1), (1, 0)]


def test_rabo(spark, tmp_path):
    (tmp_path / "r.csv").write_text("start_id;end_id;count\nNL2;NL1;3\nNL1;NL3;1\nNL2;NL1;9\n")
    g = readers.rabo(spark, str(tmp_path / "r.csv"))
    assert pairs(g, "Account", "transfer", "Account") == [(0, 2), (1, 0), (1, 0)]


def test_finbench(spark, tmp_path):
    d = put(
        tmp_path,
        Person="personId|personName\n900|x\n800|y\n",
        Account="accountId|type\n5|a\n6|b\n",
        Medium="mediumId|isBlocked\n70|true\n71|false\n",
        Loan="loanId|balance\n1|10.9\n",
        PersonOwnAccount="personId|accountId\n900|5\n900|5\n",
        AccountTransferAccount="fromId|toId|amount\n5|6|1\n5|6|2\n",
        AccountWithdrawAccount="fromId|toId|amount\n6|5|1\n",
        MediumSignInAccount="mediumId|accountId\n70|6\n",
        LoanDepositAccount="loanId|accountId\n1|6\n",
    )
    g = readers.finbench(spark, d)
    assert pairs(g, "Person", "own", "Account") == [(1, 0)]
    assert pairs(g, "Account", "transfer", "Account") == [(0, 1), (0, 1)]
    assert {r.id: r.isBlocked for r in g.vertices("Medium").collect()} == {0: 1, 1: 0}
    assert g.vertices("Loan").first().balance == 10
    assert pairs(readers.finbench_transfers(spark, d), "Account", "transfer", "Account") == [(0, 1), (0, 1)]


def test_params(spark, tmp_path):
    d = put(tmp_path, **{f"complex_{k}_param": "id|id2|start|end\n4|8|1|2\n" for k in (1, 2, 3, 6, 8)})
    got = readers.finbench_params(spark, d)
    assert got["tcr1"].first().id == 4 and tuple(got["tcr3"].first()) == (4, 8)


def test_sinks(spark, tmp_path):
    (tmp_path / "g.txt").write_text("1 2\n2 3\n")
    g = readers.snap_txt(spark, str(tmp_path / "g.txt"))
    sinks.native(g, str(tmp_path / "native"))
    again = PropertyGraph.load(spark, str(tmp_path / "native"))
    assert pairs(again, "Person", "knows", "Person") == pairs(g, "Person", "knows", "Person")
    assert again.schema.vertex("Person").count == 3 and again.schema.edge("Person", "knows", "Person").count == 4
    sinks.csv(g, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv/Person_knows_Person")).count() == 4
    sinks.label_graph(g, str(tmp_path / "label"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "label/edges")).collect())[0] == "0 1"
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "label/vertices")).collect())[0] == "0 0"
    sinks.json_results(g.vertices("Person").select("id"), str(tmp_path / "json"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "json/results")).collect()) == ["[0]", "[1]", "[2]"]


def test_json_rows_are_values(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quote"', None, [1, 2]), (None, "b", 0.5, None)], "id long, `odd name` string, x double, y array<int>")
    sinks.json_results(df, str(tmp_path))
    rows = sorted((json.loads(r[0]) for r in spark.read.text(f"{tmp_path}/results").collect()), key=str)
    assert rows == [[1, 'a "quote"', None, [1, 2]], [None, "b", 0.5, None]]
    assert [f["name"] for f in json.loads(spark.read.text(f"{tmp_path}/schema").first()[0])["fields"]] == df.columns


def test_rows_of_another_width(spark, tmp_path):
    d = put(tmp_path, short="a|b|c\n1|2|3\n4|5\n", long="a|b\n1|2|3\n4|5\n")
    with pytest.raises(Exception, match="fewer than 3 fields"):
        readers.csv(spark, f"{d}/short.csv", "|").collect()
    assert sorted(map(tuple, readers.csv(spark, f"{d}/long.csv", "|").collect())) == [("1", "2"), ("4", "5")]
    assert sorted(map(tuple, readers.csv(spark, f"{d}/short.csv", "|", ["x", "y"]).collect())) == [("1", "2"), ("4", "5")]


def test_unknown_label(spark, tmp_path):
    (tmp_path / "g.csv").write_text("node_1,node_2\n4,9\n")
    with pytest.raises(KeyError):
        readers.snap_csv(spark, str(tmp_path / "g.csv")).scan("Nobody")
