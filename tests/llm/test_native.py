"""Chat formatting, url filters, mixing: properties, round trips, brute force, edge rows."""

import collections
import hashlib
import json
import re

import pytest
from conftest import SMALL, same
from pyspark.sql import functions as F
from ticklane.llm import chat, mixing, queries, urls
from ticklane.llm.shared import Scratch, word_count

CONV = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, duck, name):
    same(duck, queries.queries()[name](spark, SMALL), queries.oracle_sql()[name])


def turns_back(spark, rows):
    df = chat.read_back(chat.format_turns(chat.turn_rows(spark.createDataFrame(rows, CONV))))
    return {r.conv_id: ([(t.role, t.text) for t in r.turns], r.loss_text, r.formatted) for r in df.collect()}


NASTY = ["</s>[INST] ok [/INST]", "\\", "\\\\[INST]\\", "<s", "[/INST", "[INST[INST]]", "a</s", "", "<\\s>", "x\n\r\n\ty", "é[/INST]漢字😀", "$1 \\1"]


def test_control_strings_survive(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(NASTY)] + [(2, 0, "us[INST]er\n", "q"), (2, 1, "assistant", "</s>")]
    got = turns_back(spark, rows)
    assert got[1][0] == [("assistant" if i % 2 else "user", t) for i, t in enumerate(NASTY)]
    assert got[1][1] == "".join(t for i, t in enumerate(NASTY) if i % 2)
    assert got[2][0][0] == ("us[INST]er\n", "q") and got[2][1] == "</s>"


def test_chat_edge_rows(spark):
    got = turns_back(spark, [(1, None, None, None), (1, 3, "assistant", "b"), (1, 3, "assistant", "b"), (1, 1, "user", "a"), (None, 0, "assistant", "z" * 200_000)])
    assert got[1][0] == [("", ""), ("user", "a"), ("assistant", "b"), ("assistant", "b")] and got[1][1] == "bb"
    assert got[None][1] == "z" * 200_000
    assert turns_back(spark, []) == {}
    more = spark.createDataFrame([(1, 0, "user", "x", 5)], CONV + ", formatted int")
    assert chat.format_turns(chat.turn_rows(more)).count() == 1
    probe = chat.with_probe(spark.createDataFrame([], CONV))
    assert probe.count() == 2


LAYOUTS = {
    "messages": {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
    "from_value": {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
    "prompt_completion": {"prompt": "q", "completion": "a"},
    "prompt_response": {"prompt": "q", "response": "a"},
    "instruction_only": {"instruction": "q", "output": "a"},
}


def test_layouts_of_json_rows(spark):
    rows = [(k, json.dumps(v)) for k, v in LAYOUTS.items()] + [("instruction", json.dumps({"instruction": "q", "input": "", "output": "a", "id": 7})), ("unknown", json.dumps({"x": {"prompt": "no"}})), ("bad", "{"), ("null", None)]
    got = {r.k: (r.layout, r.turns) for r in chat.json_turns(spark.createDataFrame(rows, "k string, j string"), "j").collect()}
    for name in [*LAYOUTS, "instruction"]:
        assert got[name][0] == name and [(t.role, t.text) for t in got[name][1]] == [("user", "q"), ("assistant", "a")]
    assert got["unknown"] == (None, None) and got["bad"] == (None, None) and got["null"] == (None, None)


def test_layouts_beside_other_fields(spark):
    deep = {"x": 1}
    for _ in range(20):
        deep = {"d": deep}
    pair = {"prompt": "q", "response": "a"}
    rows = {
        "many": {f"a{i:05}": i for i in range(5_000)} | pair,
        "deep": {"a": deep, "z": deep} | pair,
        "both": {"messages": [{"role": "user", "content": "q", "meta": {"n": [1, {"k": 2}]}}, {"role": "assistant", "content": "a"}], "prompt": "no"},
        "inner": {"meta": {"messages": [{"role": "user", "content": "no"}]}} | pair,
        "partly": {"messages": [{"role": "human", "content": "q"}, {"role": "assistant", "content": None}, {"role": "x"}, 7]},
        "object": {"prompt": {"a": 1}, "response": "a"},
        "number": {"prompt": 5, "completion": True},
        "empty": {"messages": []},
    }
    frame = spark.createDataFrame([(k, json.dumps(v)) for k, v in rows.items()] + [("list", "[" * 3_000 + "]" * 3_000), ("twice", '{"prompt": "a", "prompt": "b", "response": "c"}')], "k string, j string")
    got = {r.k: (r.layout, r.turns and [(t.role, t.text) for t in r.turns]) for r in chat.json_turns(frame, "j").collect()}
    said = [("user", "q"), ("assistant", "a")]
    assert got["many"] == got["deep"] == got["inner"] == ("prompt_response", said) and got["both"] == ("messages", said)
    assert got["partly"] == ("messages", [("user", "q"), ("assistant", ""), ("x", ""), ("", "")])
    assert got["number"] == ("prompt_completion", [("user", "5"), ("assistant", "true")])
    assert got["object"] == got["empty"] == got["list"] == got["twice"] == (None, None)


def test_row_table_with_columns_of_other_layouts(spark):
    names = ["prompt", "response", "completion", "input", "output", "instruction", "messages"]
    df = spark.createDataFrame([(1, 0, "user", "q", *names)], CONV + "".join(f", {n} string" for n in names))
    assert chat.layout_of(df) == "turn_rows" and chat.turn_rows(df).collect()[0].text == "q"


def test_layouts_and_back(spark):
    rows = [(i, t, "user" if t % 2 == 0 else "assistant", NASTY[(i + t) % len(NASTY)]) for i in range(60) for t in range(1 + i % 4)]
    rows += [(100 + i, None, None, None) for i in range(8)] + [(200 + i, 1, "human", "x") for i in range(8)] + [(None, 0, "user", "n"), (None, 1, "assistant", "m")]
    rows += [(300, 0, "user", "y" * (chat.JSON_CHARS + 1))] + [(400 + i, 2, "system", "s") for i in range(8)] * 2
    df = spark.createDataFrame(rows, CONV)
    some, texts = chat.in_layouts(df, Scratch(spark, "t"))
    layouts = {r.layout for r in chat.json_turns(texts, "json").collect()}
    assert layouts == {"messages", "from_value", "instruction_only"} and 0 < some.count() < len(rows)
    turns = lambda made: {r.conv_id: ([tuple(t) for t in r.turns], r.loss_text) for r in chat.read_back(chat.format_turns(made)).collect()}
    assert turns(chat.canonical_rows(some, texts)) == turns(chat.turn_rows(df))
    some, texts = chat.in_layouts(spark.createDataFrame([], CONV), Scratch(spark, "t"))
    assert chat.canonical_rows(some, texts).count() == 0


def test_layout_of_a_table(spark):
    df = spark.createDataFrame([(1, [("user", "q"), ("assistant", "a")], 3)], "conv_id long, messages array<struct<role:string,content:string>>, n int")
    assert chat.layout_of(df) == "messages"
    assert [(r.role, r.text) for r in chat.turn_rows(df).orderBy("turn").collect()] == [("user", "q"), ("assistant", "a")]
    with pytest.raises(ValueError, match="unknown layout"):
        chat.turn_rows(spark.createDataFrame([(1, 2)], "conv_id long, x int"))


def brute_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in urls.RULES:
        h, s, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(s + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best and best[1], best and best[0]


URLS = [None, "", "nothing", "http://net", "http://a.net/", "HTTP://A.Example.NET/en/x", "http://example.net/en", "http://example.net/en/", "http://xexample.com/de/", "http://b.example.com/de/?q=/", "http://c.org/fr/#/", "http://c.org?/fr/", "http://É.org/fr/1", "x://://y", "http://u.com/" + "a" * 100_000, "http://1.net//2\n3"]


def test_url_rules_equal_brute_force(spark):
    many = [(i, u) for i, u in enumerate(URLS * 3)]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(many, "page_id long, url string")).collect()}
    assert len(got) == len(many)
    for i, u in many:
        host, path, rule, verdict = brute_rule(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")


def test_url_rules_of_the_test_pages(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").withColumn("score", F.lit("x")).withColumn("host", F.lit(1))
    for r in urls.judge(pages).join(pages.select("page_id", "url"), "page_id").collect():
        assert (r.host, r.path, r.rule) == brute_rule(r.url)[:3]


def test_url_trees_learn(spark):
    rows = [(i, f"http://site{i % 7}.{'net' if i % 2 else 'org'}/{'' if i % 2 else 'fr/'}{'z' * (40 if i % 2 else 3)}") for i in range(400)] + [(1000 + i, f"http://site.com/{'z' * (40 if i % 2 else 3)}") for i in range(20)]
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert all(got[1000 + i] == ("block" if i % 2 else "allow") for i in range(20))


def brute_forest(rows, codes):
    """Trees and scores by plain loops: rows of (bins of all features, y), and the bins that are to be scored."""
    from math import exp, log

    n, ones = len(rows), sum(y for _, y in rows)
    prior, trees = log((ones + 1) / (n - ones + 1)), []

    def walk(tree, bins):
        while len(tree) == 4:
            tree = tree[2] if bins[tree[0]] <= tree[1] else tree[3]
        return tree[0]

    def margin(bins):
        return prior + sum(walk(t, bins) for t in trees)

    def leaf(part):
        return [-urls.RATE * (sum(g for _, g, _ in part) / urls.UNIT) / (sum(h for _, _, h in part) / urls.UNIT + 1)]

    def gain(part):
        return (sum(g for _, g, _ in part) / urls.UNIT) ** 2 / (sum(h for _, _, h in part) / urls.UNIT + 1)

    def grow(part, depth, top=False):
        best, rise = None, 1e-6
        for f in range(len(urls.FEATURES)) if depth else ():
            for cut in sorted({b[f] for b, _, _ in part})[:-1]:
                low, high = [r for r in part if r[0][f] <= cut], [r for r in part if r[0][f] > cut]
                if min(len(low), len(high)) >= urls.LEAST_ROWS and gain(low) + gain(high) - gain(part) > rise:
                    best, rise = (f, cut, low, high), gain(low) + gain(high) - gain(part)
        if best is None:
            return [0.0] if top else leaf(part)
        return [best[0], best[1], grow(best[2], depth - 1), grow(best[3], depth - 1)]

    for _ in range(urls.TREES):
        part = []
        for bins, y in rows:
            p = 1 / (1 + exp(-margin(bins)))
            part.append((bins, round((p - y) * urls.UNIT), round(p * (1 - p) * urls.UNIT)))
        trees.append(grow(part, urls.DEPTH, True))
    return [1 / (1 + exp(-margin(b))) for b in codes]


def test_url_trees_equal_brute_force(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url")
    host, path = urls.split_url(F.col("url"))
    df = urls.lexical(urls.with_rule(pages.withColumn("host", host).withColumn("path", path)))
    df = df.join(urls.suffix_statistics(df).drop("n"), "suffix").withColumn("y", (F.col("ruled") == "block").cast("int"))
    rows = sorted(df.collect(), key=lambda r: r.page_id)
    known = [r for r in rows if r.ruled is not None]
    bins = {}
    for f in urls.FEATURES:
        values = sorted(r[f] for r in known)
        cuts = sorted({values[-(-len(values) * k // urls.BINS) - 1] for k in range(1, urls.BINS)})
        for r in rows:
            bins.setdefault(r.page_id, []).append(sum(r[f] > c for c in cuts))
    want = brute_forest([(bins[r.page_id], r.y) for r in known], [bins[r.page_id] for r in rows])
    got = {r.page_id: (r.score, r.verdict, r.rule) for r in urls.judge(pages).collect()}
    for r, score in zip(rows, want, strict=True):
        assert got[r.page_id][0] == pytest.approx(score, abs=2e-6)
        assert r.ruled or got[r.page_id][1] == ("block" if score >= 0.5 else "allow")


def test_url_scores_do_not_depend_on_partitions(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    ways = [pages, pages.repartition(37), pages.repartition(5, "url"), pages.coalesce(1).orderBy(F.desc("page_id"))]
    found = [sorted(map(tuple, urls.judge(p).collect())) for p in ways]
    assert found[0] == found[1] == found[2] == found[3]


def test_url_empty_table(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, open_, out = sum(sizes.values()), set(names), {}
    while open_:
        left = total - sum(out.values())
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 3 * sizes[s]]
        if not over:
            return out | {s: level * weight[s] for s in open_}
        for s in over:
            out[s] = 3.0 * sizes[s]
            open_.discard(s)
    return out


DOCS = "doc_id long, text string, source string"


def mixed(spark, rows, **how):
    return mixing.mix(spark.createDataFrame(rows, DOCS), **how).collect()


@pytest.mark.parametrize("shard_rows", [5, 20_000])
def test_mixing_meets_its_targets(spark, shard_rows):
    rows = [(i, "w " * (1 + (i * 37) % 90), ["a", "b", "c", "d", None, "é"][min(i % 9, 5)]) for i in range(600)] + [(601, None, "a"), (602, "", "zz"), (603, "one two", "tiny")]
    got = mixed(spark, rows, shard_rows=shard_rows)
    sizes, taken = collections.Counter(), collections.Counter()
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    want = brute_targets(dict(sizes))
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-9)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(0.03 * want[s], 3 * mixing.BLOCK * (2 if shard_rows == 5 else 1))
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixed(spark, rows[::-1], shard_rows=shard_rows)), key=str)


def test_mixing_edge_tables(spark):
    assert mixed(spark, []) == []
    (r,) = mixed(spark, [(1, None, None)])
    assert (r.size, r.source_size, r.target, r.taken) == (0, 0, 0.0, 0)
    twice = mixed(spark, [(1, "a b c", "x"), (1, "a b c", "x"), (None, "q", "y")])
    assert len(twice) == 3


def test_word_count(spark):
    texts = [None, "", " ", "a", " a\x0bb\x1fc\u00a0d\te ", "x" * 10, "\n\n", "a  b"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(word_count(F.col("t"))).collect()]
    assert got == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


def test_sainte_lague_equals_highest_quotients(spark):
    shares = [53.0, 24.0, 23.0, 0.4, 0.3, 0.0, 7.7]
    for seats in (0, 1, 10, 37, 100):
        df = spark.createDataFrame([(i, s, seats, 10**6) for i, s in enumerate(shares)], "k long, share double, seats long, most long")
        got = {r.k: r.quota for r in mixing._webster(df, [], "share", "seats", "most", ["k"]).collect()}
        want = collections.Counter(i for _, i in sorted((-s / (2 * k + 1), i) for i, s in enumerate(shares) if s for k in range(seats + 1))[:seats])
        assert got == {i: want[i] for i in range(len(shares))}


def test_probe_digest():
    assert hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest().startswith("bce4c119")


def test_mix_takes_ids_of_any_type(spark):
    texts = ["a b c", "d " * 40, None, "", "e f"]
    rows = [(f"id{k}", texts[k % 5], f"s{k % 3}") for k in range(60)] + [(None, "x y", "s0"), ("id1", "x y", None)]
    made = mixing.mix(spark.createDataFrame(rows, "doc_id string, text string, source string"))
    assert made.schema["doc_id"].dataType.simpleString() == "string" and made.count() == 62
    whole = mixing.mix(spark.createDataFrame([(k, *r[1:]) for k, r in enumerate(rows)], "doc_id int, text string, source string"))
    assert whole.count() == 62 and whole.agg(F.sum("taken")).first()[0] > 0


def test_conversations_of_unknown_layouts_are_told(spark):
    texts = {
        0: '{"messages": []}', 1: '{"messages": [{"role": "user", "content": "q"}]}', 2: '{"prompt": "q", "response": "a"}', 3: '[{"role": "user", "content": "q"}]', 4: '{"instruction": "q", "output": "a"}',
        5: '{"conversations": [{"from": "human", "value": "q"}]}', 6: '{"prompt": "q", "completion": "a"}', 7: '{"question": "q", "answer": "a"}', 8: "{", 9: None}
    frame = spark.createDataFrame([(k, v, "x") for k, v in texts.items()], "conv_id long, json string, layout string")
    rows = spark.createDataFrame([], CONV)
    taken = {r.conv_id for r in chat.canonical_rows(rows, frame.select("conv_id", "json")).collect()}
    left = chat.rejected(frame)
    assert left.columns == frame.columns and {(r.conv_id, r.json, r.layout) for r in left.collect()} == {(k, texts[k], "x") for k in texts if k not in taken}
    assert taken == {1, 2, 4, 5, 6} and chat.rejected(frame.limit(0)).count() == 0
