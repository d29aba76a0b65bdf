"""Operators against brute force, exact round trips and held-out accuracy on the smallest tables."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quayside.llm import ann, chat, common, decontaminate, ngram_join, packing, pii, queries, records, tokens, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return common.table(spark, SF, "documents").toPandas()


def test_pii_base_spans_are_those_of_the_plain_patterns(docs):
    def plain(text):
        out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
            d = re.sub("[ -]", "", m[0])
            if 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
                out.append(("card", m.start(), m.end()))
        return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub(r"\D", "", m[0])) <= 15]

    r = random.Random(3)
    made = ["".join(r.choice("01459.@+- ()ab\n") for _ in range(60)) for _ in range(800)]
    for x in [*docs["text"], *made, "a@b.c@d.e", "1.2.3.4.5.6.7.8", "001.002.003.0004", "4111-1111 1111 1111"]:
        assert [tuple(s) for s in pii.base_spans(x)] == plain(x)


def test_pii_finds_more_than_the_patterns_and_keeps_base_spans():
    texts = ["write bob [at] mail [dot] org now", "call (555) 123-4567 today", "on 2024-10-11 12:30 at 3.5", "ip 10.0.0.1"]
    found = pii.find(texts)
    assert [pii.told(e) for _, e in found] == ["email:6:29", "phone:5:19", "", "ip:3:11"]
    assert pii.redacted(texts[0], found[0][1]) == "write [EMAIL] now"


def test_ann_recall_ranks_and_copies(spark):
    rng = np.random.default_rng(1)
    v = np.vstack([rng.normal(size=(600, 16)), np.repeat(rng.normal(size=(1, 16)), 60, 0)]).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = ann.search(df, df.where("vec_id % 20 == 0"), group_rows=200).toPandas()
    hit = 0
    for q, rows in got.groupby("query_id"):
        s = v.astype(float) @ v[q].astype(float)
        s[q] = -np.inf
        want = np.lexsort((np.arange(len(v)), -s))[:20]
        hit += len(set(want) & set(rows["vec_id"]))
        rows = rows.sort_values("rank")
        assert rows["rank"].tolist() == list(range(1, 21)) and rows["score"].is_monotonic_decreasing
        assert np.allclose(rows["score"], s[rows["vec_id"]])
        assert all(a < b for (a, x), (b, y) in zip(zip(rows["vec_id"], rows["score"]), zip(rows["vec_id"][1:], rows["score"][1:])) if x == y)
    assert hit >= 0.9 * 20 * got["query_id"].nunique()


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80)])
def test_jaccard_components(spark, docs, n, num):
    texts = docs["text"].tolist()
    base = texts[3].split()
    near = [" ".join([*base[:i], f"new{i}", *base[i + 1 :]]) for i in range(0, len(base), 7)]
    texts = [*texts, *near, *[" ".join(x.split()[:-1]) for x in texts[:40]]]
    sets = [set(ngram_join.gram_set(x.encode(), n).tolist()) for x in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            k = len(a & sets[j])
            if k and 100 * k >= num * (len(a) + len(sets[j]) - k):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block in (1_000_000, 600):  # whole blocks, and blocks cut in chunks
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df, n, num, 100, block_grams=block).collect()}
        assert got == {i: (len(s), find(i)) for i, s in enumerate(sets)}


def test_packing_and_records_round_trip(spark, docs):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d: [*e.ids, 1] for d, e in zip(docs["doc_id"], t.encode_batch(docs["text"].tolist(), add_special_tokens=False), strict=True)}
    got = packing.op7_packing(spark, SF).toPandas()
    for d, rows in got.groupby("doc_id"):
        at = 0
        for r in rows.sort_values("start").itertuples():
            assert (r.start, r.doc_tokens) == (at, len(ids[d])) and r.ids_crc32 == zlib.crc32(np.array(ids[d][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids[d])
    for _, rows in got.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert rows["offset"].tolist() == [0, *rows["length"].cumsum()[:-1]] and rows["length"].sum() <= 2048
    assert set(got["doc_id"]) == set(ids)

    folder, path = common.shared_dir(spark), public_tokenizers.path("byte_bpe_50k.json")
    made = records.write(common.table(spark, SF, "documents"), folder, path)
    t, at = Tokenizer.from_file(path), 0
    rows = {r.doc_id: r for r in records.read(made, folder).collect()}
    for d, text in sorted(zip(docs["doc_id"], docs["text"], strict=True)):
        x = [*t.encode(text, add_special_tokens=False).ids, 0]
        assert (rows[d].start, rows[d].n_tokens, rows[d].ids_crc32) == (at, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
        at += len(x)
    first = min(r.shard for r in made.collect())
    d, x = records.read_at(folder, first, 2)
    assert rows[d].ids_crc32 == zlib.crc32(x.tobytes())


def test_damaged_record_is_told(tmp_path):
    data = bytearray(records.frame(b"payload"))
    data[-6] ^= 1
    (tmp_path / "x").write_bytes(data)
    with open(tmp_path / "x", "rb") as f, pytest.raises(ValueError):
        records.read_record(f)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_the_library(docs, name):
    e = tokens.Encoder(public_tokenizers.path(name))
    odd = ["", " ", "  a", "a \n b", "a\t b", "x ́y", "a　 b", "<|endoftext|> hi", "don't  I'll 12 3", "a\x1c b \x1d c", "a ", "\n\n x\n y", "a.\nB", "1, 2. 3.", "Ⅷ ٣ x²", "ǅ ʰa ªb"]
    r = random.Random(5)
    odd += ["".join(r.choice("ab é.,'\n\t ́1Ǆ　") for _ in range(30)) for _ in range(500)]
    # Letters that become a letter and a mark when normalised, lines without blanks, and each of many letters before and after what is cut at.
    odd += ["ANKARA VALİLİĞİ.", "VALİLİĞİ, 2024", "a\n" * 5_000 + "b", "\n".join(["abc. de,\nf."] * 3_000), "a\n.b", "x\ńy"]
    letters = [*map(chr, [*range(0x80, 0x2000), *range(0x9DC, 0x9E0), 0x212A, 0x212B, 0xAC00, 0xFB1D, 0x1D400])]
    odd += [t for c in letters if c.isalnum() for t in (f"x{c}. y", f"{c}, b", f"a\n{c}\nb {c}.")]
    pool = "ab é.,'\n\t İ1Ǆ　\x85क़ড় "
    odd += ["".join(r.choice(pool) for _ in range(r.randint(1, 20))) for _ in range(5_000)]
    texts = [*docs["text"], *odd]
    for got, want in zip(e.encode(texts), e.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert got.tolist() == want.ids


def test_decontamination(spark, docs):
    words = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), x))
    items = [(1, "One two THREE"), (2, " ".join(f"w{i}" for i in range(20))), (3, "w3 w4 w5"), (4, "--")]
    texts = ["x one-two three y", " ".join(f"w{i}" for i in range(2, 18)), "nothing here", "one two three one two three", *docs["text"]]
    got = {r.doc_id: r for r in decontaminate.search(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_words=10).collect()}
    windows = {}
    for i, x in items:
        w = words(x)
        for a in range(max(0, len(w) - min(13, len(w)) + 1) if w else 0):
            windows.setdefault(tuple(w[a : a + min(13, len(w))]), set()).add(str(i))
    for d, x in enumerate(texts):
        w, hit, found = words(x), set(), set()
        for k in {len(q) for q in windows}:
            for a in range(len(w) - k + 1):
                if own := windows.get(tuple(w[a : a + k])):
                    hit |= set(range(a, a + k))
                    found |= own
        assert (got[d].n_words, got[d].n_hit, got[d]["items"]) == (len(w), len(hit), sorted(found))
    assert (got[1].longest_match, got[1].doc_word, got[1].item_word) == (16, 0, 2)


def test_chat_escapes_and_merges(spark):
    said = ["<s>", "<\\s>", "<\\\\/turn>", "[INST]", "a\\nb", "</s></s>", "x"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(["user", "user", "assistant", "assistant", "odd\n\\s", "assistant", "user"], said, strict=True))]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    back = chat.read_back(out).first()
    assert [(t.role, t.text) for t in back.turns] == [(r, t) for *_, r, t in rows]
    assert back.loss_text == "".join(t for *_, r, t in rows if r == "assistant")
    formatted = out.first().formatted
    assert formatted.count("<s>") == 5 and formatted.count("<turn>") == 2 and back.formatted_chars == len(formatted)
    assert [formatted[x.start : x.start + x.length] for x in out.first().loss] == ["<\\\\\\/turn>", "[\\INST]", "<\\/s><\\/s>"]


def test_language_and_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs = common.table(spark, sf, "documents").toPandas().set_index("doc_id")
    got = queries.QUERIES["op3_language"](spark, sf).toPandas().set_index("doc_id")
    held = got[got["held_out"]]
    assert (held["lang_pred"] == docs["lang"].reindex(held.index)).mean() > 0.97
    labels = common.table(spark, sf, "labels").toPandas().set_index("doc_id")
    tox = queries.QUERIES["op10_toxicity"](spark, sf).toPandas().set_index("doc_id").join(labels)
    clean = tox[tox["toxic"] == 0]
    assert clean["predicted"].mean() < 0.02 and tox[tox["toxic"] == 1]["predicted"].mean() > 0.5
    quality = queries.QUERIES["op4_quality"](spark, sf).toPandas().set_index("doc_id").join(labels)
    assert quality[quality["quality"] == 1]["keep"].mean() > 0.97 and quality[quality["quality"] == 0]["keep"].mean() < 0.2


def test_deobfuscation():
    model = toxicity.char_model(toxicity.char_counts([b"the clown is a loser and an idiot with trash " * 50]))
    for odd, word in (("tr4sh", "trash"), ("l0s3r", "loser"), ("cl0wn!!", "clown"), ("1diot", "idiot"), ("cloooown", "clown")):
        assert word in toxicity.plain(odd, model)
    assert "loser" in toxicity.spaced("a l o s e r here", model) and "idiot" in toxicity.spaced("i.d.i.o.t", model)

