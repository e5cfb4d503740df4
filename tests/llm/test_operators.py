"""Brute-force checks and edge cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing column names."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loamgrid.llm import bpe, chat, decontaminate, fingerprint, idfiles, jaccard, license, pii, quality, toxicity

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, t string, k0 string"
BASE = "the quick brown fox jumps over the lazy dog while seven old owls watch from a tall green tree near the river bank today"
TEXTS = [BASE, BASE, BASE + " indeed", "", None, "one two", "One TWO", "a" * 30_000, "worté \U0001f600\nzwei.\n\nDrei! vier? fünf", "\n \t\n", BASE.replace("owls", "cats") + " and more words follow here so that it differs"]


def docs(spark, texts=TEXTS, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en" if i is None or i % 2 else None, "s", None if t is None else len(t), "x", "y") for i, t in zip(ids, texts, strict=True)], DOCS)


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard_against_all_pairs(spark):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    texts = list(TEXTS)
    for _ in range(25):
        base = [rnd.choice(words) for _ in range(rnd.choice([4, 6, 30, 90]))]
        for _ in range(4):
            own = list(base)
            for _ in range(rnd.randint(0, max(1, len(own) // 20))):
                own[rnd.randrange(len(own))] = rnd.choice(words)
            texts.append(" ".join(own))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs(spark, texts)).collect()}
    assert got == brute_components(enumerate(texts))


def test_jaccard_empty_and_repeated(spark):
    assert jaccard.near_duplicates(docs(spark, [])).count() == 0
    kept = jaccard.keep_one(docs(spark, [BASE, BASE, None, BASE], [7, 7, None, None])).collect()
    assert len(kept) == 2 and {r.text for r in kept} == {BASE, None}


def test_bpe_matches_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t, c, rnd = Tokenizer.from_file(path), bpe.Codec(path), random.Random(1)
    parts = ["a", " ", "  ", "\n", "'s", "é", "漢", "\U0001f600", "12", "%%", "<|endoftext|>", "\x1c", "\x85", "　", "ing", "\r\n", "́"]
    for _ in range(800):
        x = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40)))
        want = t.encode(x, add_special_tokens=False).ids
        ids = c.encode(x)
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert c.decode(ids) == t.decode(want, skip_special_tokens=False)
    got = {r.doc_id: r for r in bpe.encode_documents(docs(spark), path).collect()}
    assert len(got) == len(TEXTS) and all(got[i].decoded == (x or "") for i, x in enumerate(TEXTS))
    assert bpe.digest_documents(docs(spark, []), path).count() == 0


def test_id_files_round_trip(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    ids = [5, 3, 9, 3, None, 1, 2, 20, 21, 22, 23]
    out = idfiles.fresh_path(spark)
    idfiles.write_shards(docs(spark, TEXTS, ids), path, out, shard_bytes=64)
    got = idfiles.read_shards(spark, out).orderBy("start").collect()
    rows = sorted(((-(1 << 63) if i is None else i), x or "") for i, x in zip(ids, TEXTS, strict=True))
    start = 0
    for r, (k, x) in zip(got, rows, strict=True):
        want = np.array([*t.encode(x, add_special_tokens=False).ids, 1], "<u4")
        assert (r.doc_id if r.doc_id is not None else -(1 << 63), r.start, r.n_tokens, r.ids_crc32) == (k, start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)
    found = idfiles.lookup(spark, out, spark.createDataFrame([(9,), (77,), (None,)], "doc_id bigint")).collect()
    assert [r.doc_id for r in found] == [9]


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(-(1 << 60), 1 << 60, 3000))
    s = idfiles.Shard(idfiles.pack(keys.tolist(), [b"\1\0\0\0"] * len(keys), 2))
    assert s.find_all(keys).tolist() == list(range(len(keys))) and s.find(123) is None


EMAIL, IP, CARD, PHONE = (re.compile(x) for x in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))


def brute_pii(t):
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(t):
        d = re.sub("[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(t) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_pii_against_patterns(spark):
    rnd, parts = random.Random(2), [*"0123456789@.+- ()aZ%", ".com", "@a.b", "+1 ", "192.168.0.1", "4111111111111111"]
    for _ in range(4000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60)))
        assert [s[:3] for s in pii.find_spans(t) if s.kind in pii.BASE] == brute_pii(t)
    for long in ("1" * 100_000, "1.1." * 20_000, "+1(((" * 20_000, "a@" * 40_000):
        pii.find_spans(long)
    assert [s.kind for s in pii.find_spans("bank IBAN DE89 3704 0044 0532 0130 00 ok")] == ["iban"]
    out = pii.redact(docs(spark, ["mail a.b@c.de now", None, "clean"])).orderBy("doc_id").collect()
    assert [(r.text, r.n_chars) for r in out] == [("mail [EMAIL] now", 16), (None, None), ("clean", 5)]
    assert pii.scan(docs(spark)).count() == len(TEXTS)


def test_chat_round_trip(spark):
    rows = [(-1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok"), (1, 0, "system", "be kind"), (1, 1, "us\ner\\", "a\\<|b\\\\|<\\|"), (1, 2, "assistant", "x<\\n<|" * 3000), (1, 2, None, None), (1, 2, "assistant", ""), (None, 0, "user", "hi")]
    rows += [(2, i, "assistant" if i % 2 else "user", f"turn {i} " * 40) for i in range(60)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id bigint, turn bigint, role string, text string, window_no string")
    windows = chat.format_conversations(df)
    assert windows.where("n_tokens > 1024 AND conv_id = 2").count() == 0 and windows.where("n_repeated > 0").count() > 0
    got = {r.conv_id: r for r in chat.read_back(windows).collect()}
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn, role or "", text or ""))
    for c, own in by.items():
        own.sort()
        said, loss = "".join(f"{r}\n{x}\n" for _, r, x in own), "".join(x for _, r, x in own if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_fingerprints(spark):
    got = {r.doc_id: r for r in fingerprint.fingerprint_versions(docs(spark), parts=3).collect()}
    assert len(got) == len(TEXTS) and got[0].fingerprint == got[1].fingerprint and got[0].near_next == 1
    for i, t in enumerate(TEXTS):
        t, n = t or "", TEXTS[(i + 1) % len(TEXTS)] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + n[:q]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and (t != edited or got[i].near_edited == 1)
    assert fingerprint.fingerprint_versions(docs(spark, [])).count() == 0
    assert fingerprint.fingerprint_versions(docs(spark, ["a", None, "b"], [None, 4, 4])).count() == 3


def test_fingerprint_difference_is_recovered(spark):
    old = "\n".join(f"line number {i}" for i in range(200))
    new = old.replace("number 7\n", "changed\n").replace("number 90", "gone")
    r = fingerprint.compare_versions(spark.createDataFrame([(old, new), (None, "x"), ("", "")], "o string, n string"), "o", "n").collect()
    assert [(len(x.only_old), len(x.only_new)) for x in r] == [(2, 2), (0, 1), (0, 0)]


def test_fingerprint_difference_of_long_texts_is_recovered(spark):
    rnd = random.Random(6)
    texts = ["\n".join(f"line {rnd.randrange(1 << 60)} of {i}" for i in range(n)) for n in (900, 3000, 1300)]
    units = [set(re.findall(r"[^\n.!?]{1,64}[.!?]*", t)) for t in texts]
    rows = spark.createDataFrame([(texts[0], texts[1]), (texts[2], None)], "o string, n string")
    r = fingerprint.compare_versions(rows, "o", "n").collect()
    assert [(len(x.only_old), len(x.only_new)) for x in r] == [(900, 3000), (1300, 0)]
    got = fingerprint.fingerprint_versions(docs(spark, texts), parts=2).orderBy("doc_id").collect()
    for i, (t, u, r) in enumerate(zip(texts, units, got, strict=True)):
        q = len(t) // 4
        edited = set(re.findall(r"[^\n.!?]{1,64}[.!?]*", t[: len(t) - q] + texts[(i + 1) % 3][:q]))
        assert r.n_differ == len(u ^ edited) and r.sketch_cells >= r.n_differ
        assert abs(r.near_edited - (1 - len(u ^ edited) / (len(u) + len(edited)))) < 1e-12


def test_decontamination(spark):
    rnd = random.Random(9)
    item = [f"item{rnd.randrange(900)}" for _ in range(40)]
    near = list(item)
    for p in rnd.sample(range(40), 6):
        near[p] = "other"
    texts = ["intro words " + " ".join(item).upper() + " end", " ".join(near), "clean text " * 50, None, "", " ".join(item[:20])]
    items = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "too short")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_copies(docs(spark, texts), items).collect()}
    assert set(got) == {(0, 1), (1, 1)} and got[0, 1].edits == 0 and got[1, 1].edits == 6
    assert texts[0][got[0, 1].start : got[0, 1].end] == " ".join(item).upper()
    assert {r.doc_id for r in decontaminate.keep_uncontaminated(docs(spark, texts), items).collect()} == {2, 3, 4, 5}
    assert decontaminate.find_copies(docs(spark, texts), items.limit(0)).count() == 0


def test_cgk_recall_at_the_most_edits():
    rnd = random.Random(3)
    block = decontaminate.Block([(i, " ".join(f"w{rnd.randrange(500)}" for _ in range(rnd.randint(15, 60)))) for i in range(60)])
    texts = []
    for w, k in zip(block.words, block.edits, strict=True):
        own = w.tolist()
        for _ in range(k):
            own[rnd.randrange(len(own))] = -1
        texts.append(np.array([-1] * 20 + own + [-1] * 20))
    found = {(d, i) for d, i, *_ in block.matches(texts)}
    assert sum((i, i) in found for i in range(60)) >= 59


def edited(rnd, words, k, kind):
    own = list(words)
    if kind == "even":  # as far apart as they can be: the runs between them are as short as possible
        for j in range(k):
            own[(j + 1) * len(own) // (k + 1)] = -1
        return np.array([-1] * 20 + own + [-1] * 20)
    for _ in range(k):
        op = rnd.choice("sdi") if kind == "mixed" else kind
        if op == "s":
            own[rnd.randrange(len(own))] = -1
        elif op == "d":
            del own[rnd.randrange(len(own))]
        else:
            own.insert(rnd.randrange(len(own) + 1), -1)
    return np.array([-1] * 20 + own + [-1] * 20)


@pytest.mark.parametrize("size", [3, 5, 7, 9, 10, 14, 15, 30, 52, 55, 59, 100])
def test_cgk_recall_by_size_and_kind_of_edit(size):
    rnd = random.Random(size)
    block = decontaminate.Block([(i, " ".join(f"w{rnd.randrange(500)}" for _ in range(size))) for i in range(60)])
    own = [i for i in range(60) for _ in range(4)]
    for kind in ("s", "d", "i", "mixed", "even"):
        texts = [edited(rnd, block.words[i].tolist(), block.edits[i], kind) for i in own]
        found = {(d, i) for d, i, *_ in block.matches(texts)}
        assert [d for d, i in enumerate(own) if (d, i) not in found] == [], kind


def test_toxicity_held_out(spark):
    path = "/root/testdata/sf0.1"
    d, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    model = toxicity.train(d, labels)
    held = toxicity.score_documents(d, model).join(labels, "doc_id").where("crc32(CAST(doc_id AS string)) % 5 = 0").toPandas()
    rank = held.score.rank()
    pos = held.toxic == 1
    auc = (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert auc > 0.97
    assert toxicity.score_documents(docs(spark), model).where("score < 0 OR score > 1").count() == 0
    assert toxicity.keep_clean(docs(spark), labels.limit(0)).count() == len(TEXTS)


def test_quality_model(spark):
    path = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    got = quality.classify(d, labels).join(labels, "doc_id").toPandas()
    assert got[got.quality == 1].keep.mean() > 0.98 and got[got.quality == 0].keep.mean() < 0.1
    edge = quality.classify(docs(spark), labels.limit(0)).collect()
    assert len(edge) == len(TEXTS) and all(r.keep for r in edge)


def test_quality_shards_agree(spark):
    d = docs(spark, [x for x in TEXTS if x] * 2, list(range(18)))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(18)], "doc_id bigint, quality int, toxic int")
    a, b = (sorted((r.doc_id, round(r.perplexity, 9)) for r in quality.classify(d, labels, shard_rows=n).collect()) for n in (1_000_000, 40))
    assert a == b


def test_licenses(spark):
    files = [("a/LICENSE", "Licensed under the Apache License, Version 2.0."), ("a/b/x.txt", "code " * 30), ("a/y.txt", "text " * 40 + "\nReleased under the MIT License."), ("z.txt", None), (None, "x"), ("a/b/c/LICENSE", "Released under the MIT License."), ("a/b/c/d/e.txt", "more")]
    got = {r.path: (r.license, r.status, r.from_dir) for r in license.scan(spark.createDataFrame([(*f, "s") for f in files], "path string, text string, score string")).collect()}
    assert got["a/b/x.txt"] == ("Apache-2.0", "inherited", "/a") and got["a/y.txt"][:2] == ("MIT", "own")
    assert got["a/b/c/d/e.txt"] == ("MIT", "inherited", "/a/b/c") and got["z.txt"] == (None, "none", None) and len(got) == 6


GNU = """{c} This {what} is free software{a} you can redistribute it and/or modify
{c} it under the terms of the GNU {name}General Public License as published by
{c} the Free Software Foundation{b} either version {v} of the License, or
{c} (at your option) any later version.
{c}
{c} This {what} is distributed in the hope that it will be useful,
{c} but WITHOUT ANY WARRANTY; without even the implied warranty of
{c} MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
{c} GNU {name}General Public License for more details.

code = 1
"""
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */

int main() { return 0; }
"""
MIT = """MIT License

Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND"""


def test_wrapped_license_notices(spark):
    new, old = {"a": ":", "b": ","}, {"a": ";", "b": ";"}
    files = {
        "h/1.py": ("GPL-3.0", GNU.format(c="#", what="program", name="", v="3", **new)),
        "h/2.c": ("GPL-2.0", GNU.format(c=" *", what="program", name="", v="2", **old)),
        "h/3.c": ("LGPL-2.1", GNU.format(c="//", what="library", name="Lesser ", v="2.1", **old)),
        "h/4.py": ("AGPL-3.0", GNU.format(c="", what="program", name="Affero ", v="3", **new)),
        "h/5.c": ("MPL-2.0", MPL),
        "m/17": ("MIT", MIT),
    }
    rows = [(p, t) for p, (_, t) in files.items()] + [("m/sub/18", "plain words"), ("z/6", "We talked about the license of a car and general public matters.")]
    got = {r.path: (r.license, r.status) for r in license.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert {p: got[p] for p in files} == {p: (name, "own") for p, (name, _) in files.items()}
    assert got["m/sub/18"] == ("MIT", "inherited") and got["z/6"] == (None, "none")


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_pipeline_against_brute_force(spark, sf):
    import corpus_pipeline

    got = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, sf).collect()}
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(d, labels)
    rows = [r for r in d.orderBy("doc_id").collect() if toxicity.noisy_or(toxicity.locate(r.text, model)) < 0.5]
    comp = brute_components([(r.doc_id, r.text) for r in rows])
    rows = [r for r in rows if comp[r.doc_id][1] == r.doc_id]
    items = [decontaminate.WORD.findall(r.text.lower()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    whole = {r.doc_id: " " + " ".join(decontaminate.WORD.findall(r.text.lower())) + " " for r in rows}
    rows = [r for r in rows if not any(" " + " ".join(w) + " " in whole[r.doc_id] for w in items)]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {r.doc_id: hashlib.sha256(np.array(t.encode(pii.redact_text(r.text), add_special_tokens=False).ids, "<u4").tobytes()).hexdigest() for r in rows}
    assert got == want
