import random

import duckdb
from pyspark.sql import functions as F

from loomtext.operators import collab, diversity, markdown
from loomtext.plans.editor_queries import ORACLE_SQL, QUERIES


def test_edits(spark):
    edits = spark.createDataFrame([(1, 1, "update", 1, 2, "Z"), (1, 2, "add", 0, 0, "Q"), (2, 1, "delete", 2, 99, "")], "doc_id long, seq long, action string, start int, end int, content string")
    initial = spark.createDataFrame([(1, "abc"), (2, "abc")], "doc_id long, text string")
    assert {r["doc_id"]: r["content"] for r in collab.fold_edits(edits, initial).collect()} == {1: "QaZc", 2: "ab"}
    client = edits.filter("doc_id = 1").withColumn("action", F.lit("add"))
    assert collab.fold_edits(client, initial, client=True).first()["content"] == "QaZc"
    moved = spark.range(1).select(*(collab.caret(F.lit(5), F.lit(e), F.lit(a), F.lit(1), F.lit("xyz")).alias(a) for a, e in (("add", 1), ("delete", 3), ("update", 2)))).first()
    assert tuple(moved) == (8, 3, 7)


def test_difference(spark):
    pairs = [("abc", "abXc"), ("abc", "ac"), ("abc", "aZc"), ("", ""), ("a", "a"), (None, "x")]
    got = collab.difference(spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, before string, after string")).orderBy("i").collect()
    assert [(r["action"], r["start"], r["end"], r["content"]) for r in got] == [("add", 2, 2, "X"), ("delete", 1, 2, ""), ("update", 1, 2, "Z"), (None, None, None, None), ("add", 1, 1, ""), ("add", 0, 0, "x")]


def test_delete_and_rename(spark):
    docs = spark.createDataFrame([(1, "t", 7, "0"), (2, "u", 8, "0")], "doc_id long, title string, creator long, is_delete string")
    shares = spark.createDataFrame([(1, 8), (2, 7)], "doc_id long, user_id long")
    notices = spark.createDataFrame([(1,), (2,)], "doc_id long")
    after, left, kept, code = collab.delete(docs, shares, notices, 1, 7)
    assert after.filter("is_delete = '1'").first()["doc_id"] == 1 and kept.count() == 1 and code.first()[0] == "000"
    _, left, kept, code = collab.delete(docs, shares, notices, 2, 7)
    assert left.count() == 1 and kept.count() == 2 and code.first()[0] == "000"
    assert collab.delete(docs, shares, notices, 2, 9)[3].first()[0] == "111"
    renamed, cleared = collab.rename(docs, shares, 1, 7, "new")
    assert renamed.filter("title = 'new'").count() == 1 and cleared.count() == 1


def test_greedy_rerankings(spark):
    rows = [("q", 1, 1, 0.5, [0.9, 0.0]), ("q", 2, 2, 0.4, [0.8, 0.0]), ("q", 3, 3, 0.1, [0.0, 0.7])]
    found = spark.createDataFrame(rows, "qid string, doc_id long, rank long, original double, intents array<double>")
    x = [(r["doc_id"], round(r["score"], 6)) for r in diversity.xquad(found, 0.5).orderBy("rank").collect()]
    # first 1: .25 + .5 * .45; then 3: .05 + .5 * .35 against 2: .2 + .5 * .04
    assert x == [(1, 0.475), (3, 0.225), (2, 0.22)]
    p = diversity.pm2(found, 1.0).orderBy("rank").collect()
    assert {r["doc_id"] for r in p} == {1, 2, 3}


def test_markdown_html():
    assert markdown.to_html("# A *b*\n\ntext [x](y.z)") == '<h1>A <i>b</i></h1><p>text <a class="link" target="_blank" href="http://y.z">x</a></p>'
    assert markdown.to_html("* a\n   - b\n* c") == "<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul>"
    assert markdown.to_html("'''java\nx<1\n'''") == '<pre><code class="java">x&lt;1</code></pre>'
    assert markdown.to_html("**open") == "<p>**open</p>"
    assert markdown.to_html("![i](http://h/p.png)") == '<p><img src="http://h/p.png" alt="i"></p>'


def test_codes_of_access_and_messages(spark):
    """The cases of the checks, one by one, in their order."""
    docs = spark.createDataFrame([(1, 10, "0"), (2, 10, "1"), (3, 11, "0")], "doc_id long, creator long, is_delete string")
    shares = spark.createDataFrame([(3, 10)], "doc_id long, user_id long")
    users = spark.createDataFrame([(10,), (11,)], "user_id long")
    asked = spark.createDataFrame([(10, 1, True), (10, 2, True), (10, 3, True), (11, 1, True), (10, 9, True), (10, 1, False)], "user_id long, doc_id long, signed_in boolean")
    assert sorted(tuple(r) for r in collab.access(asked, docs, shares).collect()) == sorted([(10, 1, "000"), (10, 2, "122"), (10, 3, "000"), (11, 1, "111"), (10, 9, "111"), (10, 1, "120")])
    good = {"action": "doc/add", "uid": "10", "docid": "1", "start": "0", "end": "2", "content": "x"}
    cases = [
        (good, "000"), (good | {"uid": 10, "docid": 3}, "000"), (good | {"uid": "12"}, "117"), (good | {"uid": "ten"}, "113"), (good | {"docid": "4"}, "111"), (good | {"docid": "2"}, "122"), (good | {"uid": "11"}, "111"),
        (good | {"action": "chat"}, "000"), (good | {"action": "/chat/"}, "000"), (good | {"action": "sing"}, "113"), (good | {"action": "addUser"}, "113"), (good | {"action": "delUser", "shared_user": "3"}, "000"),
        (good | {"action": "doc/sing"}, "112"), (good | {"action": "any/init", "start": "no"}, "000"), (good | {"action": "a/b/c"}, "113"), (good | {"start": "one"}, "113"), ({k: v for k, v in good.items() if k != "end"}, "113"),
        ({k: v for k, v in good.items() if k != "content"}, "113"), ({k: v for k, v in good.items() if k != "action"}, "113"), ({k: v for k, v in good.items() if k != "docid"}, "113"), (None, "113"),
    ]
    import json

    rows = spark.createDataFrame([(i, json.dumps({"data": d}) if d else "[") for i, (d, _) in enumerate(cases)], "id long, raw string")
    got = {r["id"]: r["code"] for r in collab.route(rows, users, docs, shares).collect()}
    assert [got[i] for i in range(len(cases))] == [c for _, c in cases]


def test_rooms(spark):
    events = [(1, 1, 5, "join"), (1, 2, 6, "join"), (1, 3, 5, "join"), (1, 4, 5, "leave"), (1, 5, 9, "leave"), (1, 6, 7, "join"), (1, 7, 5, "join")]
    df = spark.createDataFrame(events, "room long, seq long, user_id long, action string")
    assert sorted((r["user_id"], r["since"], r["until"]) for r in collab.stays(df).collect()) == [(5, 1, 4), (5, 7, None), (6, 2, None), (7, 6, None)]
    heard = {}
    for r in collab.welcomes(df).collect():
        heard.setdefault(r["seq"], set()).add(r["receiver"])
    assert heard == {1: {5}, 2: {5, 6}, 6: {6, 7}, 7: {5, 6, 7}}


def test_broadcasts_count_what_present_lists(spark):
    rng = random.Random(4)
    places = {(rng.randrange(3), rng.randrange(150), rng.randrange(6)) for _ in range(900)}
    events = [(*p, rng.choice(["join", "join", "leave", "talk", None])) for p in places] + [(0, 7, None, "join"), (None, 7, 1, "join"), (0, None, 1, "leave"), (9, 1, 1, "join")]
    df = spark.createDataFrame(events, "room long, seq long, user_id long, action string")
    heard = collab.present(df.select("room", "seq", "user_id"), collab.stays(df.dropna(subset=["seq"]))).filter("receiver <> user_id")
    assert len({e[:2] for e in events}) < len(events)
    assert {(r["room"], r["seq"]): r["receivers"] for r in collab.broadcasts(df).collect()} == {(r["room"], r["seq"]): r["count"] for r in heard.groupBy("room", "seq").count().collect()}


def test_broadcasts_do_not_list_receivers(spark, tmp_path):
    """No step makes more rows than there are events, though nearly every one has many receivers."""
    events = spark.range(600).select((F.col("id") * 40).alias("event_id"), (F.col("id") * 7).alias("user_id"), F.when(F.col("id") % 4 == 3, "error").otherwise("view").alias("event_type"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    sent = QUERIES["room_broadcasts"](spark, str(tmp_path))
    got = sorted((r["room"], r["seq"], r["receivers"]) for r in sent.collect())
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == sorted(duck.execute(ORACLE_SQL["room_broadcasts"]).fetchall()) and sum(r[2] for r in got) > 6000
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    ran = store.executionsList().last().executionId()
    nodes, values = store.planGraph(ran).allNodes(), store.executionMetrics(ran)
    measures = [nodes.apply(i).metrics().apply(j) for i in range(nodes.size()) for j in range(nodes.apply(i).metrics().size())]
    made = [int(values.apply(m.accumulatorId()).replace(",", "")) for m in measures if m.name() == "number of output rows" and values.contains(m.accumulatorId())]
    assert made and max(made) <= 600


def test_fields_that_are_null_and_places_with_fractions(spark):
    bodies = ['"content":null', '"content":"c"', '"content":null,"start":1.5,"end":2', '"content":"c","start":"1.5","end":2', '"content":"c","start":true,"end":2', '"other":1', '"content":"c","shared_user":null']
    actions = ["chat", "chat", "doc/add", "doc/add", "doc/add", "chat", "addUser"]
    rows = [(i, f'{{"data":{{"action":"{a}","uid":"7","docid":1,{b}}}}}') for i, (a, b) in enumerate(zip(actions, bodies))]
    docs = spark.createDataFrame([(1, 7, "0")], "doc_id long, creator long, is_delete string")
    found = collab.route(spark.createDataFrame(rows, "id int, raw string"), spark.createDataFrame([(7,)], "user_id long"), docs, spark.createDataFrame([], "doc_id long, user_id long"))
    assert [r["code"] for r in found.orderBy("id").collect()] == ["000", "000", "000", "113", "113", "113", "000"]
