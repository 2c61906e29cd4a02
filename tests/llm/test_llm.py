"""The operators against brute force, round trips and held-out accuracy, and on odd inputs."""

import base64
import hashlib
import io
import itertools
import math
import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from axiomata.llm import ann, decontam, langid, licenses, lmscore, mixing, quality, queries, shingles, simhash, tokens, warc
from axiomata.llm.components import connected_components
from axiomata.llm.scratch import Scratch

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, "Same words here again, and more of them.", "en", "a", 1),
    (2, "same words here again, and more of them.", "en", "a", 1),
    (2, "same words here again, and more of them.", "en", "a", 1),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (None, "ein Text ohne Kennung", "de", None, 3),
    (5, " \t\n", "de", "b", 3),
    (6, "1 2 3 !!", "fr", "a", 8),
    (7, "mot " * 30_000, "fr", "c", 120_000),
    (8, "the cat sat on the mat and the dog sat on the log", "en", "c", 50),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "x", 0) for r in ODD], DOCS + ", score string, size int")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def brute_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    parts = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs):
    """pairs of (id, fingerprint) -> {id: least id reachable}."""
    n = len(pairs)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(n), 2):
        if bin(pairs[i][1] ^ pairs[j][1]).count("1") <= 3:
            root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(pairs):
        least[find(i)] = min(least.get(find(i), key), key)
    return [least[find(i)] for i in range(n)]


def brute_near(rows):
    """(id, text) -> least ids over links of at most 3 bits or of five-word sets at Jaccard 0.8 or more."""
    bits = [brute_fingerprint(t) for _, t in rows]
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        alike = bool(a and b) and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b) - 1e-9
        if alike or bin(bits[i] ^ bits[j]).count("1") <= 3:
            root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), key), key)
    return [least[find(i)] for i in range(len(rows))]


# --- 1


def test_warc_matches_brute_force(spark):
    rows = [(3, "u3", "aa"), (1, "u1", "aa"), (2, None, None), (9, "u", ""), (5, "ü", "é"), (5, "v", "é"), (None, "n", "zz"), (7, "w", "x" * 200_000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    got = {}
    for r in warc.round_trip(spark, pages).collect():
        got.setdefault(r["page_id"], []).append((r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]))
    sha = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    assert got[1] == [(2, sha("aa"), "response", None)] and got[3] == [(2, sha("aa"), "revisit", 1)]
    assert got[2] == [(0, sha(""), "response", None)] and got[9] == [(0, sha(""), "revisit", 2)]
    assert sorted(got[5], key=str) == [(2, sha("é"), "response", None), (2, sha("é"), "revisit", 5)]
    assert got[None] == [(2, sha("zz"), "response", None)] and got[7][0][:2] == (200_000, sha("x" * 200_000))
    assert sum(map(len, got.values())) == len(rows)


def test_warc_empty_small_and_rolled(spark):
    schema = "page_id long, url string, html string"
    assert warc.round_trip(spark, spark.createDataFrame([], schema)).count() == 0
    pages = spark.createDataFrame([(i, "u", "ab" if i % 2 else "") for i in range(50)], schema)
    kinds = warc.round_trip(spark, pages, min_revisit_bytes=1, roll_records=3, force_zip64=True).groupBy("record_type").count().collect()
    assert {r["record_type"]: r["count"] for r in kinds} == {"response": 26, "revisit": 24}


@pytest.mark.parametrize("wide", [False, True])
def test_zip_members_agree_with_zipfile(wide):
    import zipfile

    out = io.BytesIO()
    writer = warc.ZipWriter(out, wide)
    for name, data in (("a/ü.txt", b"hello"), ("b", b""), ("c", os.urandom(70_000))):
        writer.begin(name)
        writer.write(data)
        writer.end()
    writer.close()
    raw = out.getvalue()
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert z.testzip() is None
        names = {n: z.read(n) for n in z.namelist()}
    members = warc.zip_members(pa.BufferReader(raw))
    assert {n: raw[o : o + s] for n, (o, s) in members.items()} == names


def test_zip_members_of_other_tools():
    import zipfile

    with pytest.raises(ValueError):
        warc.zip_members(pa.BufferReader(b"nothing here at all, not even a directory"))
    with pytest.raises(ValueError):
        warc.zip_members(pa.BufferReader(b"x" * 100 + b"PK\5\6" + b"\xff" * 18))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x", "y" * 1000)
        z.writestr(zipfile.ZipInfo("stored"), b"PK\5\6 inside")
        z.comment = b"a comment with PK\5\6" + b"\xff" * 30
    raw = b"bytes before the archive" + out.getvalue()
    members = warc.zip_members(pa.BufferReader(raw))
    assert {n: raw[o : o + s] for n, (o, s) in members.items()} == {"stored": b"PK\5\6 inside"}
    with pytest.raises(ValueError, match="compressed"):
        warc.zip_members(pa.BufferReader(raw), lambda n: n == "x")
    for cut in range(1, len(raw), 37):
        with pytest.raises(ValueError):
            warc.zip_members(pa.BufferReader(raw[:-cut]))
    with pytest.raises(ValueError):
        warc.zip_members(pa.BufferReader(raw.replace(b"PK\3\4", b"PK\3\5")))


def foreign_record(kind, url, body, packed=True):
    import gzip

    block = b"HTTP/1.1 200 OK\r\n\r\n" + body if kind == "response" else body
    head = f"WARC/1.0\r\nwarc-type: {kind}\r\nWARC-Target-URI: {url}\r\nWARC-Record-ID: <urn:x:{url}>\r\nContent-Type: {'application/http; msgtype=response' if kind == 'response' else 'text/plain'}\r\nContent-Length: {len(block)}\r\n\r\n"
    raw = head.encode() + block + b"\r\n\r\n"
    return gzip.compress(raw) if packed else raw


@pytest.mark.parametrize("index", ["plain", "packed", "none"])
def test_packages_of_other_tools_are_read(spark, tmp_path, index):
    import gzip
    import json
    import zipfile

    files = {"a.warc.gz": [("warcinfo", "i", b"software: x")] + [("response", f"http://a/{i}", b"body %d" % i * i) for i in range(5)], "b.warc": [("response", "http://b/0", b""), ("resource", "http://b/1", b"text")]}
    lines = ['!meta {"format": "x"}']
    with zipfile.ZipFile(f"{tmp_path}/p.wacz", "w") as z:
        z.writestr("datapackage.json", "{}" * 500, zipfile.ZIP_DEFLATED)
        for name, records in files.items():
            data = b""
            for kind, url, body in records:
                one = foreign_record(kind, url, body, name.endswith("gz"))
                lines.append(f"{url} 20200101000000 " + json.dumps({"url": url, "filename": name, "offset": str(len(data)), "length": len(one)}))
                data += one
            z.writestr(f"archive/{name}", data, zipfile.ZIP_STORED)
        text = ("\n".join(sorted(lines, reverse=index == "packed")) + "\n").encode()
        if index != "none":
            z.writestr("indexes/index.cdx.gz" if index == "packed" else "indexes/index.cdxj", gzip.compress(text) if index == "packed" else text, zipfile.ZIP_STORED)
        z.writestr("pages/pages.jsonl", "{}", zipfile.ZIP_DEFLATED)
    packages = spark.createDataFrame([(f"file://{tmp_path}/p.wacz",)], "path string")
    got = {r["url"]: (r["record_type"], bytes(r["payload"]) if r["payload"] is not None else None, r["page_id"]) for r in warc.read_records(warc.locate_records(packages), with_payload=True).collect()}
    assert got == {u: (k, b if k != "warcinfo" else None, None) for records in files.values() for k, u, b in records}


def test_warc_records_name_what_they_revisit(spark):
    pages = spark.createDataFrame([("b\r\nX: 1", "u", "same"), ("", "v", "same"), ("a%0D", "w", "same"), (None, "n", "same")], "page_id string, url string, html string")
    got = warc.read_records(warc.locate_records(warc.archive_pages(spark, pages)), with_payload=True).collect()
    first = next(r for r in got if r["record_type"] == "response")
    assert first["page_id"] == "" and bytes(first["payload"]) == b"same" and sorted((r["page_id"] for r in got), key=str) == sorted(["b\r\nX: 1", "", "a%0D", None], key=str)
    assert all(r["refers_to"] == "" and r["refers_to_record"] == first["record_id"] for r in got if r is not first)


# --- 2


@pytest.fixture(scope="module")
def licence_model():
    return licenses.train()


def test_licences_native_scores_equal_the_model(spark, odd, none, licence_model):
    model = licence_model
    texts = [t for t, _ in licenses.notices()[::7]] + [f.format(x) for f in licenses._FRAMES for x in licenses._FOREIGN[1::4]]
    texts += ["x\nReleased under the MIT License.\ny", "plain words\n\nGPLv3", "no notice", "", None, "x " * 50_000 + "\nSPDX-License-Identifier: BSD-2-Clause", "Licensed under the MIT License.", "Licensed under the MIT License."]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "Licensed under the MIT License.", 2), (3, "Licensed under the MIT License.", 2)], "doc_id int, text string, words int")
    got = sorted(((r["id"], r["paragraph"], r["notice"], r["family"], r["probability"], r["template_similarity"], r["confirmed"]) for r in licenses.scan(docs, model).collect()), key=str)
    expected = []
    for i, t in [*enumerate(texts), (None, texts[-1]), (3, texts[-1])]:
        for k, line in enumerate(t.split("\n") if t else []):
            p = model.probabilities(line)
            if p.argmax() < len(model.families) - 1:
                family = model.families[p.argmax()] if p.max() >= 0.6 else "unknown"
                near = model.similarity(line, family) if family != "unknown" else 0.0
                expected.append((i, k, line, family, p.max(), near, near >= 0.5))
    expected.sort(key=str)
    assert len(got) == len(expected) > 100
    key = lambda r: (str(r[0]), r[1], r[2], r[3])
    for g, x in zip(sorted(got, key=key), sorted(expected, key=key)):
        assert g[:4] == x[:4] and g[6] == x[6] and g[4:6] == pytest.approx(x[4:6], abs=1e-9)
    plan = licenses.scan(docs, model)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert licenses.scan(odd, model).count() == 0 and licenses.scan(none, model).count() == 0


def test_every_generated_notice_is_found(licence_model):
    rows = [(t, f) for t, f in licenses.notices() if f in licenses.FAMILIES]
    found = [licence_model.families[licence_model.probabilities(t).argmax()] for t, _ in rows]
    assert "none" not in found and np.mean([f == g for (_, g), f in zip(rows, found)]) > 0.98
    plain = [t for t, f in licenses.notices() if f == "none"]
    assert np.mean([licence_model.probabilities(t)[-1] > 0.5 for t in plain]) > 0.97
    strange = [licence_model.probabilities(f.format(x)) for f in licenses._FRAMES for x in licenses._FOREIGN[1::2]]
    assert np.mean([p.argmax() < len(licence_model.families) - 2 and p.max() >= 0.6 for p in strange]) <= 0.25
    assert licence_model.families[licence_model.probabilities("").argmax()] == "none"


def test_wrapped_notices_are_one_paragraph(spark, licence_model):
    text = "Some words here.\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:\n\nNext"
    got = licenses.scan(spark.createDataFrame([(1, text)], "doc_id int, text string"), licence_model).collect()
    assert [(r["paragraph"], r["family"], r["confirmed"]) for r in got] == [(1, "bsd", True)] and got[0]["template_similarity"] == 1.0


# --- 3


def test_myers_equals_dynamic_programming():
    draw = random.Random(5)
    for _ in range(300):
        p, t = [draw.choice("abcd") for _ in range(draw.randint(1, 9))], [draw.choice("abcd") for _ in range(draw.randint(0, 20))]
        row = list(range(len(p) + 1))
        best = None
        for j, c in enumerate(t):
            nxt = [0]
            for i, x in enumerate(p):
                nxt.append(min(row[i] + (x != c), row[i + 1] + 1, nxt[i] + 1))
            row = nxt
            if row[-1] <= 3 and (best is None or row[-1] < best[0]):
                best = (row[-1], j + 1)
        assert decontam.best_match(p, t, 3) == best


def test_decontamination_finds_edited_items(spark, none, odd):
    draw = random.Random(7)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(4))
    items = [[word() for _ in range(draw.randint(1, 30))] for _ in range(25)]
    items += [items[0], ["the"], []]
    texts, expected = [], set()
    for i in range(120):
        body = [word() for _ in range(60)]
        own = draw.randrange(25)
        edited = list(items[own])
        for _ in range(int(len(edited) * 0.2) if i % 3 else 0):
            k = draw.randrange(len(edited))
            edited[k : k + 1] = draw.choice([[], [word()], [edited[k], word()]]) if len(edited) > 1 else [edited[k]]
        texts.append((i, " ".join(body[:30]).upper() + "\n" + ", ".join(edited) + ". " + " ".join(body[30:])))
    docs = spark.createDataFrame([*texts, (None, None), (200, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(99, None)], "item_id long, text string")
    for doc, text in texts:
        words = decontam.normal_words(text)
        for i, w in enumerate(items):
            if w:
                hit = decontam.best_match(w, words, min(len(w) - 1, int(len(w) * 0.2 + 1e-9)))
                if hit:
                    expected.add((doc, i, hit[0]))
    assert len(expected) > 100
    for size in (2_000_000, 40):
        got = {(r["id"], r["item"], r["distance"]) for r in decontam.contaminated(docs, bench, block_words=size).collect()}
        assert got == expected
    assert decontam.contaminated(none, bench).count() == 0 and decontam.contaminated(docs, bench.limit(0)).count() == 0
    clean = decontam.decontaminate(spark, docs, bench)
    assert {r["doc_id"] for r in clean.collect()} == {d for d, *_ in texts + [(None,), (200,)]} - {d for d, *_ in expected} and clean.columns == docs.columns
    assert decontam.decontaminate(spark, odd, bench).columns == odd.columns


# --- 4


def test_simhash_matches_brute_force(spark, none):
    draw = random.Random(3)
    base = [draw.choice("abcdefghij") * 3 for _ in range(120)]
    texts = []
    for _ in range(90):
        t = list(base)
        for _ in range(draw.randint(0, 3)):
            t[draw.randrange(len(t))] = draw.choice("xyz")
        texts.append(" ".join(t))
    texts += ["", None, " \n", "One two", "one TWO", "é É", "x" * 50_000, "a b c " * 9000]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int")
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    expected = dict(zip([i for i, _ in rows], brute_components(fps)))
    for dense in (512, 3):
        got = {r["id"]: (r["fp"] % (1 << 64), r["component"]) for r in simhash.near_duplicates(spark, docs, dense=dense).collect()}
        assert got == {i: (f, expected[i]) for i, f in fps}
    assert len(set(expected.values())) < 60
    assert simhash.near_duplicates(spark, none).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_ball_links_give_the_components_of_all_pairs(spark, radius):
    draw = random.Random(radius)
    centre = draw.getrandbits(64)
    values = {centre ^ sum({1 << draw.randrange(64) for _ in range(draw.randint(0, 4))}) for _ in range(150)} | {draw.getrandbits(64) for _ in range(50)} | {0, (1 << 64) - 1}
    fps = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in sorted(values)], "fp long")

    def classes(links):
        root = {v: v for v in values}

        def find(v):
            while root[v] != v:
                v = root[v]
            return v

        for a, b in links:
            root[find(a)] = find(b)
        found = {}
        for v in values:
            found.setdefault(find(v), set()).add(v)
        return {frozenset(x) for x in found.values()}

    expected = classes((a, b) for a, b in itertools.combinations(values, 2) if bin(a ^ b).count("1") <= radius)
    for dense in (1000, 2):
        got = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.near_links(fps, Scratch(spark, "t"), radius, dense).collect()]
        assert all(bin(a ^ b).count("1") <= radius for a, b in got)
        assert classes(got) == expected


def test_components_of_a_long_path(spark):
    n = 300
    edges = spark.range(n).selectExpr("(id * 7919) % 301 as a", "((id + 1) * 7919) % 301 as b").unionByName(spark.createDataFrame([(500, 501), (501, 500), (502, 502)], "a long, b long"))
    got = {r["node"]: r["root"] for r in connected_components(edges, Scratch(spark, "c")).collect()}
    assert len(got) == 303 and set(got.values()) == {0, 500} and got[501] == 500


def test_variants_of_one_file_are_made_in_many_tasks(spark):
    draw = random.Random(8)
    own = {0, -1, *(draw.getrandbits(64) - (1 << 63) for _ in range(298))}
    fps = spark.createDataFrame([(f,) for f in own], "fp long").coalesce(1)
    balls = simhash._half_balls(fps, 3).withColumn("task", F.spark_partition_id())
    tasks = {r["task"]: r["count"] for r in balls.groupBy("task").count().collect()}
    assert sum(tasks.values()) == 66 * len(own)
    assert len(tasks) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(tasks.values()) < 66 * len(own) // 2
    assert {r["fp"]: r["count"] for r in balls.distinct().groupBy("fp").count().collect()} == dict.fromkeys(own, 66)


def test_deduplicate_keeps_columns_and_leaders(spark, odd):
    got = simhash.deduplicate(spark, odd)
    assert got.columns == odd.columns
    ids = [r["doc_id"] for r in got.collect()]
    assert ids.count(None) == 1 and 1 in ids and 2 not in ids and 3 in ids and 4 not in ids and 5 not in ids


def test_near_copies_by_shingles(spark):
    draw = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for base in range(30):
        text = [draw.choice(words) for _ in range(200)]
        rows.append((len(rows), " ".join(text)))
        for edits in (1, 2, 3, 4, 5, 8, 20):
            other = list(text)
            for at in draw.sample(range(200), edits):
                other[at] = draw.choice(words)
            rows.append((len(rows), " ".join(other)))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(196)} for _, t in rows]
    near = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {r["id"]: r["component"] for r in simhash.near_duplicates(spark, docs, similar=0.8).collect()}
    bits = {r["id"]: r["component"] for r in simhash.near_duplicates(spark, docs).collect()}
    assert len(near) > 60 and all(whole[i] == whole[j] for i, j in near) and any(bits[i] != bits[j] for i, j in near)
    assert all(rows[i][1] and i // 8 == c // 8 for i, c in whole.items())


def test_loose_copies_meet_in_few_pairs(spark, monkeypatch):
    draw = random.Random(6)
    base = [f"w{draw.randint(0, 900)}" for _ in range(150)]

    def edited(words, edits):
        other = list(words)
        for at in draw.sample(range(len(other)), edits):
            other[at] = f"z{draw.randint(0, 10**6)}"
        return other

    texts = [base] + [edited(base, draw.randint(2, 9)) for _ in range(399)]
    texts += [edited(t, 1) for t in texts[1:41]]  # these are linked
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = [set(shingles.shingle_set(" ".join(t)).tolist()) for t in texts]
    near = {i: i for i in range(len(texts))}
    for i, j in itertools.combinations(near, 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            old, new = sorted((near[i], near[j]), reverse=True)
            near = {k: new if c == old else c for k, c in near.items()}
    made = []
    for name in ("centre_pairs", "class_pairs"):
        monkeypatch.setattr(shingles, name, lambda lead, similar, f=getattr(shingles, name): made.append(f(lead, similar).count()) or f(lead, similar))
    scratch = Scratch(spark, "t")
    wide = scratch.keep(shingles.features(docs), "f")
    by_fp = {}
    for r in wide.select("id", "fp").collect():
        by_fp.setdefault(r["fp"], []).append(r["id"])
    found = {i: i for i in range(len(texts))}
    links = [(by_fp[a][0], by_fp[b][0]) for a, b in shingles.set_links(wide, scratch, 0.8).collect()]
    for i, j in links + [(ids[0], k) for ids in by_fp.values() for k in ids[1:]]:
        old, new = sorted((found[i], found[j]), reverse=True)
        found = {k: new if c == old else c for k, c in found.items()}
    assert found == near and 100 < len(set(near.values())) < 400
    # all pairs are 96,580, of which the bands of loose copies hold a good part
    assert sum(made) < 10 * len(texts), made


# --- 5


def test_quality_columns_equal_the_model_and_learn(spark, none, odd):
    draw = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        good = i % 4 > 0
        words = [draw.choice(["thing", "word", "other", "some", "tree", "house", "river"]) + str(draw.randint(0, 9)) * (draw.random() < 0.05) for _ in range(draw.randint(5, 60))]
        rows.append((i, ". ".join(words) if good else " ".join(w.upper() + "!!" for w in words)))
        labels.append((i, int(good)))
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (None, "x y")], "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit(docs, marks, sample=1000)
    got = quality.scored(docs, model)
    stats = docs.select("doc_id", *[c.alias(n) for n, c in quality.statistics(docs["text"]).items()]).toPandas().fillna({"doc_id": -1}).set_index("doc_id")
    own = dict(zip(stats.index, model.predict(stats.to_numpy(float))))
    for r in got.collect():
        assert r["score"] == pytest.approx(own[r["doc_id"] if r["doc_id"] is not None else -1], abs=1e-9)
    right = [(r["score"] >= 0.3) == bool(dict(labels)[r["doc_id"]]) for r in got.collect() if r["doc_id"] in dict(labels)]
    assert np.mean(right) > 0.99
    assert quality.scored(none, model).count() == 0
    assert {r["score"] for r in quality.scored(docs, quality.fit(none, marks)).collect()} == {0.5}
    clash = quality.scored(odd, model)
    assert clash.count() == len(ODD) and clash.columns.count("score") == 1 and "size" in clash.columns
    twice = quality.fit(docs.unionByName(docs), marks.unionByName(marks), sample=1000)
    assert twice.rules == quality.fit(docs.repartition(3), marks, sample=1000).rules


def test_quality_holds_out(spark):
    got = queries.op5_quality(spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    both = got.merge(labels, on="doc_id")
    held = both[both.held_out]
    assert (held.predicted == held.quality).mean() > 0.95 and got.score.between(0, 1).all()


# --- 6


@pytest.fixture(scope="module")
def counter():
    return tokens.counter(queries.vocab("word_bpe_49k.json"))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(st.sampled_from("aetnosh'dlvr<|>ofx 1É²ßŉΣ\n"), max_size=60))
def test_counts_equal_the_library(text):
    count = tokens.counter(queries.vocab("word_bpe_49k.json"))
    assert count.count(text) == len(count.library.encode(text, add_special_tokens=False).ids)


def test_every_prefix(counter):
    for word in ("international", "thntblereofstanding", "naïveté", "x"):
        raw = word.encode()
        expected = [0] + [len(counter.library.encode(raw[:i].decode(errors="ignore"), add_special_tokens=False).ids) for i in range(1, len(raw) + 1)]
        got = counter.word(word)
        whole = [i for i in range(len(raw) + 1) if raw[:i].decode(errors="ignore").encode() == raw[:i]]
        assert [got[i] for i in whole] == [expected[i] for i in whole]


MIXED = ["It’s segmentation", "Привет, мир! ΣΑΣ ὈΔΥΣΣΕΎΣ", "東京タワー 漢字かな", "e\u0301te\u0301 İstanbul I'LL", "a<|endoftext|>b <|startoftext|><|x", "emoji 😀👍🏽 and ² ½ ٣", "tab\tnew\nline\x0b\x1c\u3000x", "they're don't 'S 'ſ", "मानक हिन्दी", "\u0301 lone mark", "ß ŉ ﬁ ǅ"]


@pytest.mark.parametrize("text", MIXED)
def test_every_prefix_of_mixed_scripts(counter, text, monkeypatch):
    expected = [len(counter.library.encode(text[:n], add_special_tokens=False).ids) for n in range(len(text) + 1)]
    monkeypatch.setattr(counter, "library", None)  # the library is not called
    assert counter.count(text) == expected[-1]
    ends, counts = counter.prefixes(text)
    assert all(expected[e] == c for e, c in zip(ends, counts))
    assert [counter.at(text, ends, counts, n) for n in range(len(text) + 1)] == expected
    for limit in range(expected[-1] + 2):
        n, kept = counter.within(text, limit)
        assert n == expected[-1] and expected[kept] <= limit
        assert kept == len(text) if n <= limit else kept == max([0, *(e for e, c in zip(ends, counts) if c <= limit)])


def test_every_code_point_of_the_first_plane(counter):
    for at in range(0, 0xD800, 0x900):
        text = " ".join(f"a{chr(c)}1{chr(c)}" for c in range(at, at + 0x900))
        assert counter.count(text) == len(counter.library.encode(text, add_special_tokens=False).ids)


def test_token_index_answers_budgets(spark, counter, odd, none):
    path = queries.vocab("word_bpe_49k.json")
    got = tokens.token_counts(odd, path, 100).collect()
    assert len(got) == len(ODD)
    assert {r["id"]: r["n_tokens"] for r in got if r["id"]} == {i: counter.count(t) for i, t, *_ in ODD if i}
    assert all(r["over_limit"] == (r["n_tokens"] > 100) for r in got) and {r["id"]: r["kept_chars"] for r in got}[7] == 399
    assert tokens.token_counts(none, path, 1).count() == 0
    cut = tokens.prefix_index(odd, path).withColumn("kept", tokens.cut_to_budget(5)).collect()
    text = {i: t or "" for i, t, *_ in ODD}
    for r in cut:
        if r["id"] is not None:
            assert counter.count(text[r["id"]][: r["kept"]]) <= 5
            assert r["kept"] == (r["ends"] or [0])[-1] or counter.count(text[r["id"]][: next(e for e in r["ends"] if e > r["kept"])]) > 5


# --- 7


def test_forward_sums_all_segmentations():
    model = langid.Model(["x"], ["a", "b", "ab", "ba", "aba"], np.array([[0.3], [0.2], [0.1], [0.1], [0.25], [0.05]]))

    def total(word):
        if not word:
            return 1.0
        out = 0.0
        for n in range(1, min(5, len(word)) + 1):
            piece = word[:n]
            p = dict(zip(model.pieces, model.probs[:, 0])).get(piece, 0.05 if n == 1 else 0)
            out += p * total(word[n:])
        return out

    words = ["a", "ab", "abab", "ababa", "cab", "bbbb", "abaabacab"]
    assert model.log_likelihoods(words)[:, 0] == pytest.approx([math.log(total(w)) for w in words])


def log_total(model, word, column):
    """The sum over all segmentations in plain logarithms."""
    probs = dict(zip(model.pieces, model.probs[:, column]))
    sums = [0.0]
    for end in range(1, len(word) + 1):
        terms = [sums[end - n] + math.log(probs[word[end - n : end]]) for n in range(1, min(end, model.longest) + 1) if word[end - n : end] in probs]
        if word[end - 1] not in probs:
            terms.append(sums[end - 1] + math.log(model.probs[-1, column]))
        top = max(terms)
        sums.append(top + math.log(sum(math.exp(t - top) for t in terms)))
    return sums[-1]


def test_language_posteriors_equal_brute_force(spark, monkeypatch):
    draw = random.Random(8)
    pieces = ["a", "b", "ab", "ba", "aba", "abbab", "bbbbbbbb", "abababababab", "c"]
    probs = np.random.default_rng(1).dirichlet(np.ones(10), 3).T
    model = langid.Model(["x", "y", "z"], pieces, probs)
    words = ["".join(draw.choice("abcd") for _ in range(n)) for n in (1, 2, 3, 11, 30, 31, 45, 200, 1500)] + ["漢字" * 20, "b" * 700]
    expected = [[log_total(model, w, i) for i in range(3)] for w in words]
    assert np.allclose(model.log_likelihoods(words), expected, rtol=1e-9)
    monkeypatch.setattr(langid, "LETTERS", 120)  # long words in windows
    assert np.allclose(model.log_likelihoods(words), expected, rtol=1e-9)
    texts = [" ".join(draw.choice(words) for _ in range(3)) for _ in range(10)] + [words[4].upper() + "1" + words[0], "12"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in langid.identify(docs, model).collect():
        own = [sum(log_total(model, w, i) for w in langid.WORD.findall(texts[r["id"]].lower())) for i in range(3)]
        if not any(own):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        odds = [math.exp(v - max(own)) for v in own]
        assert r["lang_pred"] == "xyz"[own.index(max(own))] and r["score"] == pytest.approx(max(odds) / sum(odds))


def test_expected_uses_equal_enumeration():
    model = langid.Model(["x"], ["a", "b", "ab", "aba"], np.array([[0.3], [0.2], [0.2], [0.25], [0.05]]))

    def ways(word):
        if not word:
            return [((), 1.0)]
        out = []
        for n in range(1, len(word) + 1):
            i = model.pieces.index(word[:n]) if word[:n] in model.pieces else 4 if n == 1 else None
            if i is not None:
                out += [((i, *rest), model.probs[i, 0] * p) for rest, p in ways(word[n:])]
        return out

    words, weights = ["abab", "cab", "abaaba", "b"], np.array([2.0, 1.0, 3.0, 1.0])
    expected = np.zeros(5)
    for w, k in zip(words, weights):
        all_ = ways(w)
        for path, p in all_:
            for i in path:
                expected[i] += k * p / sum(q for _, q in all_)
    assert langid._expectation(model, words, weights, 0) == pytest.approx(expected)


def test_language_accuracy_and_odd_texts(spark, odd, none):
    got = queries.op7_language(spark, "/root/testdata/sf0.01").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(docs, on="doc_id")
    assert (both[both.held_out].lang == both[both.held_out].lang_pred).mean() > 0.97
    path = queries.vocab("piece_bpe_32k.model")
    model = langid.fit(odd, path)
    rows = {r["id"]: r for r in langid.identify(odd, model).collect()}
    assert [rows[i]["lang_pred"] for i in (3, 4, 5, 6)] == ["und"] * 4 and rows[8]["lang_pred"] == "en" and rows[7]["lang_pred"] == "fr"
    assert langid.identify(none, model).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, langid.fit(none, path)).collect()} == {"und"}
    kept = langid.keep_identified(odd, model, 0.5)
    assert kept.columns == odd.columns and {3, 4, 5, 6}.isdisjoint(r["doc_id"] for r in kept.collect())


# --- 8


def brute_targets(sizes):
    """Repeated resharing: fixed sources stop at twice their size."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_mixing_targets_and_caps(spark, odd, none):
    draw = random.Random(2)
    rows = [(i, "w " * int(draw.lognormvariate(4, 1)), draw.choice(["a", "b", "B", "é", None, "src0", "src0", "src0"])) for i in range(3000)]
    docs = spark.createDataFrame([*rows, (None, "x y z", "a"), (7, rows[7][1], rows[7][2])], "doc_id long, text string, source string")
    got = mixing.mix(spark, docs).toPandas()
    sizes = {}
    for i, t, s in [*rows, (None, "x y z", "a"), rows[7]]:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    expected = brute_targets(sizes)
    for s, own in got.groupby(got.source.fillna("null")):
        s = None if s == "null" else s
        assert own.source_size.iloc[0] == sizes[s] and own.target.iloc[0] == pytest.approx(expected[s])
        assert abs(own.taken.sum() - expected[s]) < 0.01 * expected[s]
    assert (got.taken <= 2 * got["size"]).all() and (got.taken == got.copies * got["size"]).all() and len(got) == 3002
    again = mixing.mix(spark, docs.repartition(7)).toPandas()
    assert sorted(zip(got.id.fillna(-1), got.taken)) == sorted(zip(again.id.fillna(-1), again.taken))
    assert mixing.mix(spark, none).count() == 0
    few = mixing.mix(spark, odd).toPandas()
    assert len(few) == len(ODD) and (few.taken <= 2 * few["size"]).all()


# --- 9


def test_chi_square():
    assert ann.chi_square_cdf(12.592, 6) == pytest.approx(0.95, abs=1e-4) and ann.chi_square_quantile(0.9, 8) == pytest.approx(13.3616, abs=1e-3)


def test_nearest_recall_ties_and_odd_vectors(spark):
    draw = np.random.default_rng(4)
    x = draw.standard_normal((900, 16)).astype(np.float32) * draw.uniform(0.5, 2, (900, 1)).astype(np.float32)
    x[100:400] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [1.0, None] + [0.0] * 14), (1080, [1.0]), (1100, [float("inf")] * 16), (None, [1.0] * 16), (20, rows[20][1])]
    vectors = spark.createDataFrame([(*r, 1) for r in rows + bad], "vec_id long, embedding array<float>, v int")
    got = ann.nearest(spark, vectors, vectors.filter("vec_id % 20 = 0"), k=20, cell_rows=100, query_block=16, sample=400).toPandas()
    hits, wide = 0, x.astype(np.float64)
    assert set(got.query_id) == set(range(0, 900, 20))
    for q, own in got.groupby("query_id"):
        score = [(-(wide[q] * w).sum(), i) for i, w in enumerate(wide) if i != q]
        best = {i for _, i in sorted(score)[:20]}
        assert len(own) == 20 and sorted(own["rank"]) == list(range(1, 21)) and q not in set(own.vec_id)
        assert np.allclose(own.score, [(wide[q] * wide[i]).sum() for i in own.vec_id], rtol=0, atol=1e-9)
        order = own.sort_values("rank")
        assert list(zip(-order.score, order.vec_id)) == sorted(zip(-order.score, order.vec_id))
        hits += len(best & set(own.vec_id))
    assert hits >= 0.9 * 20 * 45
    few = vectors.filter("vec_id < 5")
    assert ann.nearest(spark, few, few.filter("vec_id = 0")).count() == 4
    assert ann.nearest(spark, vectors.limit(0), vectors).count() == 0


@pytest.mark.parametrize("kind", ["tinyint", "string", "decimal(20,0)", "date"])
def test_nearest_takes_ids_of_any_kind_and_several_widths(spark, kind, monkeypatch):
    monkeypatch.setattr(ann, "LANE_BYTES", 1000)  # many lanes and groups
    monkeypatch.setattr(ann, "GROUP", 2)
    draw = np.random.default_rng(6)
    rows = [(i, draw.standard_normal(5 if i % 3 else 9).tolist()) for i in range(100)]
    made = "date_add(date'2020-01-01', i)" if kind == "date" else f"cast(i as {kind})"
    vectors = spark.createDataFrame(rows, "i int, embedding array<double>").selectExpr(f"{made} as vec_id", "embedding", "i")
    got = ann.nearest(spark, vectors, vectors.filter("i % 4 = 0"), k=3, cell_rows=8, query_block=4, sample=64, confidence=0.9999)
    name = {r["vec_id"]: r["i"] for r in vectors.collect()}
    best = {}
    for q, v in rows[::4]:
        best[q] = sorted((-float(np.dot(v, w)), i) for i, w in rows if i != q and len(w) == len(v))[:3]
    found = {(name[r["query_id"]], r["rank"], name[r["vec_id"]]) for r in got.collect()}
    expected = {(q, n, i) for q, own in best.items() for n, (_, i) in enumerate(own, 1)}
    assert len(found) == len(expected) and len(found & expected) >= 0.95 * len(expected)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/check_s"), reason="needs the larger table")
def test_recall_with_production_parameters(spark):
    e = spark.read.parquet("/root/testdata/check_s/embeddings.parquet")
    got = queries.op9_nearest(spark, "/root/testdata/check_s").toPandas()
    rows = e.toPandas()
    x, ids = np.stack(rows.embedding.map(np.array)).astype(float), rows.vec_id.to_numpy()
    assert len(x) > 10_000
    hits = n = 0
    for q, own in got.groupby("query_id"):
        s = x @ x[np.flatnonzero(ids == q)[0]]
        s[ids == q] = -np.inf
        hits += len(set(ids[np.argsort(-s, kind="stable")[:20]]) & set(own.vec_id))
        n += 20
    assert hits / n >= 0.9


# --- 10


def brute_phrases(part, others):
    """Greedy cover of a list of words by the longest runs that occur in another text's parts."""
    lines = [f" {' '.join(o)} " for o in others]
    at = n = 0
    while at < len(part):
        k = 1
        while at + k < len(part) and any(f" {' '.join(part[at : at + k + 1])} " in line for line in lines):
            k += 1
        at += k
        n += 1
    return n


def brute_own(words):
    seen, phrase, n = {()}, (), 0
    for w in words:
        phrase += (w,)
        if phrase not in seen:
            seen.add(phrase)
            phrase, n = (), n + 1
    return n + bool(phrase)


def test_cross_parsing_equals_search():
    draw = random.Random(9)
    for trial in range(150):
        letters = "abc" if trial % 2 else "abcdefghijkl"
        parts = [[draw.choice(letters) for _ in range(draw.randint(0, 25))] for _ in range(draw.randint(1, 7))]
        owners = list(np.cumsum([0] + [draw.randint(0, 1) for _ in parts[1:]]))
        owners = [int(o) for o in owners]
        for p, o, (cross, own) in zip(parts, owners, lmscore.cross_parse(parts, owners)):
            assert cross == brute_phrases(p, [q for q, w in zip(parts, owners) if w != o]) and own == brute_own(p)


def test_symbols():
    assert lmscore.symbols("a  b\x1cc\n d") == ["a", "b\x1cc", "d"] and lmscore.symbols("né ein\u00a0x") == ["né", "ein\u00a0x"]
    assert lmscore.symbols("ab漢字cd 文") == ["ab", "漢", "字", "cd", "文"] and lmscore.symbols(" ") == []


def test_lm_scores_equal_brute_force(spark, odd, none):
    draw = random.Random(0)
    rows = [(i, " ".join(draw.choice(["river", "house", "under", "stone", "walk", f"w{draw.randint(0, 300)}"]) for _ in range(draw.randint(1, 60)))) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(4)] + [(None, rows[0][1]), (None, "alone here"), (200, rows[5][1] + " end"), (201, None), (202, " \n")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, h1 int")
    got = lmscore.lm_scores(spark, docs).collect()
    texts = {t: t.split() for _, t in rows if t and t.split()}
    whole = sum(map(len, texts.values()))
    expected = []
    for i, t in rows:
        w = texts.get(t, [])
        if not w:
            expected.append((i, len(t or ""), 0, 0, 0, 0, 0, 0.0, 0.0))
            continue
        n, again = sum(u == t for _, u in rows), sum(u == t for _, u in rows) > 1
        r = whole - len(w) + (len(w) if again else 0)
        c, o = 1 if again else brute_phrases(w, [v for u, v in texts.items() if u != t]), brute_own(w)
        expected.append((i, len(t), len(w), n, r, c, o, c * math.log2(r) / len(w), (c * math.log2(len(w)) - o * math.log2(o)) / len(w)))
    assert len(got) == len(expected)
    key = lambda r: str(tuple(r)[:7])
    for g, x in zip(sorted(got, key=key), sorted(expected, key=key)):
        assert tuple(g)[:7] == tuple(x)[:7] and tuple(g)[7:] == pytest.approx(tuple(x)[7:])
    assert lmscore.lm_scores(spark, none).count() == 0 and lmscore.lm_scores(spark, odd).count() == len(ODD)


def test_lm_scores_over_many_shards(spark):
    draw = random.Random(1)
    common = " ".join(f"c{i}" for i in range(30))
    rows = [(i, f"{common} " + " ".join(f"w{draw.randint(0, 200)}" for _ in range(40))) for i in range(300)] + [(1000 + i, " ".join(f"z{draw.randint(0, 10**6)}" for _ in range(60))) for i in range(20)]
    rows += [(2000, "x " * 150_000 + "end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = lmscore.lm_scores(spark, docs, shard_bytes=6000).toPandas().set_index("id")
    assert len(got) == 321 and got.reference_words[got.index < 300].max() < 12_000
    # the common passage is one phrase wherever its texts were spread
    assert (got.phrases[got.index < 300] <= 41).mean() > 0.9 and (got.phrases[(got.index >= 1000) & (got.index < 2000)] == 60).all()
    assert got.n_words[2000] == 150_001 and got.cross_entropy[got.index < 300].max() < got.cross_entropy[(got.index >= 1000) & (got.index < 2000)].median() + 8
    again = lmscore.lm_scores(spark, docs.repartition(5), shard_bytes=6000).toPandas().set_index("id")
    assert got.sort_index().equals(again.sort_index())


def test_lm_shards_are_packed_and_never_cut(spark):
    assert lmscore.packed([], 10) == [] and lmscore.packed([(3, 4), (1, 5)], 10) == [(1, 0), (3, 0)]
    draw = random.Random(4)
    for n in (5, 40, 300):
        loads = {s: int(draw.paretovariate(1.2)) for s in range(n)}
        found = dict(lmscore.packed(list(loads.items()), 20))
        size = {k: [loads[s] for s in found if found[s] == k] for k in set(found.values())}
        assert set(found) == set(loads) and set(size) == set(range(len(size)))
        assert len(size) == 1 or all(sum(v) >= 20 for v in size.values())
    size = Counter(dict(lmscore.packed([(s, 2) for s in range(105)], 20)).values())
    assert len(size) == 10 and set(size.values()) <= {10, 11}
    # texts of one size under keys of their own: what is left of a cut shard was a small reference
    rows = [(i, " ".join(f"w{draw.randint(0, 10**6)}" for _ in range(60))) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r["reference_words"] for r in lmscore.lm_scores(spark, docs, shard_bytes=3000).collect()]
    least = 3000 * 60 * 900 / sum(len(t) for _, t in rows) - 60
    assert len(got) == 900 and min(got) > least - 60 and max(got) < 2 * least + 120


def test_attach_splits_large_groups(spark):
    from axiomata.llm.attach import attach

    rows = spark.range(5000).selectExpr("id", "if(id < 3000, 0, id) as k")
    facts = rows.groupBy("k").count().withColumnRenamed("count", "n")
    got = attach(rows, facts, ["k"], "n", 5000).collect()
    assert len(got) == 5000 and {(r["k"], r["n"]) for r in got} == {(0, 3000)} | {(i, 1) for i in range(3000, 5000)}


def test_words_of_scripts_without_spaces():
    assert decontam.normal_words("Ab_1 漢字かx, ñ") == ["ab_1", "漢", "字", "か", "x", "ñ"]
    item = "東京都知事選挙の結果について説明する文章です"
    block = decontam.Block([(1, decontam.normal_words(item))], 0.2)
    assert block.matches(block.finder(), "前の文。" + item.replace("結", "欠") + "続き")[0][:2] == (1, 1)


def test_scratch_is_deleted(spark):
    from axiomata.llm import scratch

    with scratch.scope():
        own = Scratch(spark, "gone")
        first = own.keep(spark.range(3), "a")
        path = own._at[id(first)].removeprefix("file://").removeprefix("file:")
        second = own.keep(first, "b", (first,))
        assert not os.path.exists(path) and second.count() == 3
        folder = own.root.removeprefix("file://").removeprefix("file:")
    assert not os.path.exists(folder)


# --- pipeline


def test_mixed_rows_hold_the_mix(spark):
    rows = [(i, "word " * (5 + i % 40), "en", "abc"[i % 3 if i % 2 else 0], 1) for i in range(300)] + [(900, "", "en", "a", 0), (901, None, "en", "b", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    want = {r["id"]: r["copies"] for r in mixing.mix(spark, docs).collect() if r["copies"]}
    got = mixing.mixed_rows(spark, docs).collect()
    assert {r["doc_id"]: r["copies"] for r in got} == want and len(got) == len(want)
    assert {0, 2} <= {want.get(i, 0) for i in range(300)}


def test_pipeline_against_its_operators(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, sf)
        assert out.columns == docs.columns, name
        kept = {r["doc_id"] for r in out.select("doc_id").collect()}
        rows = [(r["doc_id"], r["text"]) for r in at.collect()]
        assert len(kept) > 0.5 * len(rows)
        if name == "near_dedup":
            assert kept == set(brute_near(rows))
        if name == "decontaminate":
            bench = [decontam.normal_words(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert kept == {i for i, t in rows if not any(decontam.best_match(w, decontam.normal_words(t), int(len(w) * 0.2 + 1e-9)) for w in bench)}
        at = spark.createDataFrame(out.collect(), docs.schema)
    mixed = corpus_pipeline.STAGES[-1][1](spark, at, sf).toPandas()
    assert set(docs.columns) < set(mixed.columns) and (mixed.taken == mixed.copies * mixed.text.str.split().str.len()).all()
    assert corpus_pipeline.run(spark, sf).count() == len(mixed)


def test_stages_on_odd_tables(spark, odd, none, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, 1), (4, 0), (None, None)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, None), (1, "the dog sat on the log"), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
        out = stage(spark, odd, str(tmp_path))
        assert set(odd.columns) <= set(out.columns) and out.count() <= len(ODD) + 1
