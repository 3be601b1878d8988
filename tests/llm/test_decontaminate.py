"""Decontamination against a brute-force search for every window, and against SQL."""

import hashlib
import random
import re

import duckdb

from metricloom.llm import decontaminate as de
from metricloom.llm.queries import ORACLE_SQL, op3_decontaminate


def brute(text, items, window=10):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    doc, hit, found = split(text), set(), set()
    for item, t in items:
        w = split(t)
        k = min(window, len(w))
        wins = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
        for i in range(len(doc) - k + 1 if w else 0):
            if tuple(doc[i : i + k]) in wins:
                hit |= set(range(i, i + k))
                found.add(item)
    return len(doc), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def cases():
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "B", "c", "dé", "e1", "ff"])
    items = [(str(i), " ".join(word() for _ in range(rng.choice([1, 3, 9, 10, 14, 40])))) for i in range(30)] + [("", "..."), ("30", None), ("2", "a B c dé")]
    docs = [(i, ", ".join(word() for _ in range(rng.randrange(60)))) for i in range(80)] + [(80, None), (81, ""), (None, "a b c"), (82, items[4][1]), (82, items[4][1]), (83, "x " * 3000 + items[5][1])]
    return docs, items


def check(spark, block_words):
    docs, items = cases()
    long_items = [x for x in items if len((x[1] or "").split()) not in (1, 3)]
    for given in (items, long_items):
        frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, n_words string, spans int")
        bench = spark.createDataFrame([(i or None, t) for i, t in given], "item_id string, text string")
        got = de.digest(de.matches(frame, bench, block_words=block_words)).collect()
        wanted = sorted((d or -1, *brute(t, given)) for d, t in docs)
        assert sorted((r.doc_id or -1, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got) == wanted
        assert all(r.contaminated == (r.n_hit > 0) for r in got)


def test_against_brute_force(spark):
    check(spark, de.BLOCK_WORDS)


def test_many_blocks(spark):
    check(spark, 60)


def test_long_item_is_cut_with_overlap(spark):
    text = " ".join(f"w{i}" for i in range(100))
    bench = spark.createDataFrame([("1", text)], "item_id string, text string")
    docs = spark.createDataFrame([(1, text), (2, " ".join(f"w{i}" for i in range(43, 53)))], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_hit) for r in de.digest(de.matches(docs, bench, block_words=25)).collect()) == [(1, 100), (2, 10)]


def test_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    wanted = con.execute(f"SELECT {', '.join(names)} FROM ({ORACLE_SQL['op3_decontaminate']})").fetchall()
    assert sorted(wanted) == sorted(tuple(r) for r in op3_decontaminate(spark, sf_dir).select(*names).collect())
    assert any(r[-1] for r in wanted)


def test_removal(spark):
    item = " ".join(f"w{i}" for i in range(12))
    bench = spark.createDataFrame([("1", item)], "item_id string, text string")
    clean = "some other words that stand here for a while and then more of them until it is long enough to stay in"
    rows = [(1, f"{clean}. {item.upper()}! {clean}", 7), (2, item, 7), (3, clean, 7), (4, None, None), (5, "", 7), (None, "w0 w1 w2 w3 w4 " + item + " w5 w6 w7 w8 w9 w10 w11 " + clean, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = {r.doc_id: r.text for r in de.remove(docs, bench).collect()}
    assert got[1] == f"{clean}. \n! {clean}" and 2 not in got and got[3] == clean and got[4] is None and got[5] == "" and "w5" not in (got.get(None) or "")
    empty = spark.createDataFrame([], bench.schema)
    assert de.remove(docs, empty).count() == 6 and de.remove(docs.limit(0), bench).count() == 0
    assert {r.n_hit for r in de.digest(de.matches(docs, empty)).collect()} == {0}


def test_removal_is_alike_with_one_block_and_many(spark):
    rng = random.Random(6)
    items = [" ".join(f"{c}{i}" for i in range(12)) for c in "abcdef"]
    rest = lambda n: " ".join(f"r{rng.randrange(10**6)}" for _ in range(n))
    first, last = items[0].split(), items[-1].split()
    texts = [f"{items[0]} {rest(16)} {items[-1]}", f"{rest(40)} {items[0]} {rest(5)} {items[-1]}!", rest(9), None, ""]
    texts.append(" ".join(first[:6]) + f" {items[-1]} " + " ".join(first[6:]) + " " + rest(40))  # a cut joins an item of the first block
    texts.append(" ".join(last[:6]) + f" {items[0]} " + " ".join(last[6:]) + " " + rest(40))
    texts += [" ".join(rng.choice([*items, rest(10), rest(3), rest(25)]) for _ in range(6)) for _ in range(60)]
    bench = spark.createDataFrame([(str(i), x) for i, x in enumerate(items)], "item_id string, text string")
    docs = spark.createDataFrame([(i, x, "t", i) for i, x in enumerate([*texts, texts[1]])], "doc_id long, text string, spans string, row int")
    one, many = (de.remove(docs, bench, block_words=n) for n in (1000, 24))
    assert many.schema.names == docs.columns
    wanted = sorted(map(str, one.collect()))
    assert sorted(map(str, many.collect())) == wanted
    assert len(wanted) < len(texts) and not any("doc_id=0," in x for x in wanted)
    assert sorted(map(str, de.remove(docs.where("doc_id in (2, 3, 4)"), bench, block_words=24).collect())) == [x for x in wanted if re.match(r"Row\(doc_id=[234],", x)]


def test_columns_of_any_name_come_back(spark):
    """Whatever the blocks: names that the operator uses itself, and names with dots."""
    item = " ".join(f"w{i}" for i in range(12))
    names = ["doc_id", "text", "row", "__row", "__new", "__stays", "stays", "doc", "h", "id", "a.b"]
    rows = [(1, f"{item} " + "other words " * 20, *("mine",) * 9), (2, None, *("yours",) * 9), (3, item, *("gone",) * 9)]
    docs = spark.createDataFrame(rows, ", ".join(f"`{n}` {'long' if n == 'doc_id' else 'string'}" for n in names))
    bench = spark.createDataFrame([("1", item, "x", "y"), ("2", " ".join(f"v{i}" for i in range(400)), "x", "y")], "item_id string, text string, __id string, id string")
    for limit in (12, 10_000):
        out = de.remove(docs, bench, block_words=limit)
        assert out.columns == names
        assert sorted(tuple(r)[2:] for r in out.collect()) == [("mine",) * 9, ("yours",) * 9]
        found = {r.doc_id: r.n_hit for r in de.digest(de.matches(docs, bench, block_words=limit)).collect()}
        assert found == {1: 12, 2: 0, 3: 12}


def test_only_windows_that_items_may_have_leave_tasks(spark, monkeypatch):
    """A benchmark far larger than a block: the map rules out nearly all windows, and what occurs is found."""
    rng = random.Random(8)
    text = lambda n: " ".join(f"t{rng.randrange(10**9)}" for _ in range(n))
    items = [(str(i), text(30)) for i in range(2_000)]
    docs = [(i, text(50) + " " + items[i * 97][1] + " " + text(50)) for i in range(20)] + [(20 + i, text(120)) for i in range(200)]
    bench, frame = spark.createDataFrame(items, "item_id string, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(de, "MAP_BITS", 1 << 20)
    kept = de.occurring(bench, frame, "text", "text", 10, 1_000)
    assert {r.item_id for r in kept.collect()} == {str(i * 97) for i in range(20)}
    got = {r.doc_id: (r.n_hit, r.n_items) for r in de.digest(de.matches(frame, bench, block_words=1_000)).collect()}
    assert got == {i: (30, 1) if i < 20 else (0, 0) for i in range(220)}
