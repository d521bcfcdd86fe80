import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlspike.llm import chat, decontaminate, mixing, neardup, pii, ranking, secrets, simhash, sstable, stats, supervision, toxicity
from marlspike.llm.queries import tokenizer_path
from marlspike.llm.text import folded_words, shingle_hashes
from marlspike.session import scratch_path, table

DATA = "/root/testdata/sf0.001"
#: Nulls, empty and repeated rows, ties, a long text, and extra columns with names that the operators use inside.
ODD = [(None, None, None, None), (1, "", "a", 1), (1, "", "a", 1), (2, None, "a", 2), (3, "tok " * 3000, "b", 3), (4, "one two three four", None, 4), (4, "one two three four", None, 4), (-5, "ça va İ.", "b", 5)]
SCHEMA = "doc_id long, text string, source string, score long"


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    return df.select("*", F.lit("en").alias("lang"), *[F.lit(0).alias(c) for c in ("fp", "node", "row", "key", "size", "k", "n_chars")])


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, DATA, "documents").cache()


def test_shards_round_trip(spark, odd, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    for df in (odd, docs):
        path = scratch_path(spark, "t")
        sstable.write(df, path, tokenizer_path(), shard_bytes=20_000)
        got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in sstable.read_index(spark, path).orderBy("start").collect()]
        want = Counter()
        for r in df.collect():
            ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
            want[r.doc_id, len(ids), zlib.crc32(ids.tobytes())] += 1
        assert Counter((d, n, c) for d, _, n, c in got) == want
        assert [g[1] for g in got] == [0, *np.cumsum([g[2] for g in got])[:-1].tolist()]
        keys = [sstable.key_of(g[0]) for g in got]
        assert keys == sorted(keys)
        assert {r.doc_id for r in sstable.lookup(spark, path, [4, 5, 10**12]).collect()} == {d for d in (4, 5) if any(g[0] == d for g in got)}
    empty = scratch_path(spark, "t")
    sstable.write(odd.limit(0), empty, tokenizer_path())
    assert sstable.read_index(spark, empty).count() == 0


def test_memo_equals_whole_text_encoding():
    """Odd texts: punctuation around words, apostrophes, digits, marks that combine, special tokens, other scripts."""
    from tokenizers import Tokenizer

    tok, draw = Tokenizer.from_file(tokenizer_path()), np.random.default_rng(8)
    bits = ["word", "Word", "WÖRTER", "it's", "dogs'", "l'", "'s", "$$$", "&&&", ".", ",", "!?", "a1b2", "42", "e\u0301", "\u0301", "İ", "ı", "ß", "ŉ", "日本", "<|endoftext|>", "<|", "|>", "x_y", "_", "-", "\t", "\n", "\r\n", "\u00a0", "\u2028", "\u3000", "ǅ", "K", "ſ", "é.", "foo...", "(bar)", "w" * 60, "😀", "\0"]
    texts = ["".join(draw.choice(bits) + draw.choice(["", " ", " ", "  "]) for _ in range(draw.integers(0, 12))) for _ in range(4000)] + [None, "", " "]
    for memo in (sstable.WordMemo(tokenizer_path(), 2, 1), sstable.WordMemo(tokenizer_path(), 4, 1, limit=50)):
        kind = np.dtype(memo.kind)
        for lo in range(0, len(texts), 400):
            part = texts[lo : lo + 400]
            want = [np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], kind).tobytes() for t in part]
            assert memo.encode(pa.array(["skip", *part], pa.string())[1:]) == want
    chunks = [*sstable.byte_chunks(pa.array(["ab", None, "c" * 50, "", "d"], pa.string()), 10)]
    assert chunks == [(0, 2), (2, 3), (3, 5)] and [*sstable.byte_chunks(pa.array([], pa.string()))] == []


def test_simhash_equals_brute_force(spark, odd, docs):
    for df in (odd, docs):
        rows = df.select("doc_id", "text").collect()
        prints = np.array([simhash.fingerprint(r.text or "", 3) for r in rows], np.uint64)
        label = list(range(len(rows)))
        for i in range(len(rows)):
            for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 3):
                a, b = label[i], label[int(j)]
                label = [min(a, b) if x in (a, b) else x for x in label]
        low = {x: min((r.doc_id for r, y in zip(rows, label) if y == x and r.doc_id is not None), default=None) for x in set(label)}
        want = Counter((r.doc_id, format(int(p), "016x"), low[x]) for r, p, x in zip(rows, prints, label))
        assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.link(df).collect()) == want
    assert simhash.link(odd.limit(0)).count() == 0


def test_near_copies_go(spark):
    draw = np.random.default_rng(3)
    text = lambda: [f"w{i}" for i in draw.integers(0, 5000, 300)]
    rows, base = [], [text() for _ in range(20)]
    for g, words in enumerate(base):
        for i in range(4):
            copy = list(words)
            for at in draw.choice(300, i, replace=False):
                copy[at] = "changed"
            rows.append((g * 10 + i, " ".join(copy)))
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(kept) == 20 and {r.doc_id // 10 for r in kept} == set(range(20))


def test_forest_equals_brute_force():
    draw = np.random.default_rng(5)
    seeds = draw.integers(0, 2**63, 12, dtype=np.uint64)
    x = np.unique([s ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for s in seeds for a, b in draw.integers(0, 64, (25, 2))]).astype(np.uint64)
    from marlspike.llm.components import forest

    for over in (200_000, 10):
        label = list(range(len(x)))
        for a, b in zip(*forest(x, 3, over)):
            p, q = label[a], label[b]
            label = [min(p, q) if y in (p, q) else y for y in label]
        want = list(range(len(x)))
        for i in range(len(x)):
            for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= 3):
                p, q = want[i], want[int(j)]
                want = [min(p, q) if y in (p, q) else y for y in want]
        assert label == want


def test_matches_tolerate_edits(spark, odd):
    item = "the quick brown fox jumps over the lazy dog while seven wizards quietly brew strong ale in the dark cellar"
    near = item.replace("quick", "quikc").replace("strong ", "strong\n")
    bench = spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id long, text string")
    df = spark.createDataFrame([(1, "x " * 50 + item + " y"), (2, "Before. " + near.upper()), (3, item[:60]), (4, None), (5, "a b")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_edits for r in decontaminate.matches(df, bench).collect()}
    assert got == {(1, 7): 0, (2, 7): 2}
    assert sorted(r.doc_id for r in decontaminate.clean(df, bench).collect()) == [3, 4, 5]
    assert decontaminate.matches(odd, bench.limit(0)).count() == 0 and decontaminate.clean(odd, bench).count() == len(ODD)


def test_mix_meets_targets(spark, odd, docs):
    for df in (odd, docs):
        rows = mixing.mix(df).collect()
        assert len(rows) == df.count()
        for s in {r.source for r in rows}:
            own = [r for r in rows if r.source == s]
            assert 0 <= int(own[0].target) - sum(r.taken for r in own) <= len(own) and all(r.taken <= 3 * r.size for r in own)
        words = sum(len((r.text or "").split()) for r in mixing.mixed(df.select("doc_id", "text", "lang", "source", "n_chars")).collect())
        assert words == sum(r.taken for r in rows)
    assert mixing.mix(odd.limit(0)).count() == 0


def test_near_groups_hold_no_pair_below_the_bound(spark):
    """Two families whose texts come near each other, one of them a chain, many enough for a large cell."""
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 120)]

    def edit(words, n):
        out = list(words)
        for i in rng.choice(len(out), n, replace=False):
            out[i] = f"e{rng.integers(0, 10**6)}"
        return out

    other = edit(base, 5)
    texts = [" ".join(edit(w, rng.integers(1, 4))) for w in (base, other) for _ in range(40)]
    for _ in range(5):
        texts.append(" ".join(edit(texts[-1].split(), 2)))
    texts += [texts[0], "", "", "a b", "A b"]
    sets = [set(np.unique(shingle_hashes(folded_words(t), 5)).tolist()) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    df = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    for nearest in (1, 8):
        got = {r.row: r.group for r in neardup.groups_of(df, nearest=nearest).collect()}
        assert [got[i] for i in range(len(texts))] == label


def test_hot_cells_are_split_without_loss(spark, monkeypatch):
    """Cells over the block size, whose members link in a chain only."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[i : i + 100]) for i in range(0, 300, 6)] + ["a b c"] * 30
    got = {r.row: r.group for r in neardup.groups_of(spark.createDataFrame(list(enumerate(texts)), "row long, text string")).collect()}
    assert got == {i: 0 if i < 50 else 50 for i in range(80)}


def test_deduplicate_keeps_the_lowest_whatever_the_partitions(spark, docs):
    runs = []
    for n in (1, 7):
        kept = simhash.deduplicate(docs.repartition(n, F.rand(n))).collect()
        runs.append(sorted((r.doc_id, r.text) for r in kept))
    assert runs[0] == runs[1]
    groups = {r.row: r.group for r in neardup.groups_of(docs.select(F.col("doc_id").alias("row"), "text")).collect()}
    assert [r[0] for r in runs[0]] == sorted(set(groups.values()))


def test_statistics_equal_brute_force(spark, odd, docs):
    for r in [*docs.limit(60).collect(), *odd.collect()]:
        text = r.text or ""
        words, got = re.findall(r"[^\x20\x09-\x0D]+", text), stats.of(text)
        grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        hit = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (got.n_words, got.n_repeat_words, got.n_dup_lines) == (len(words), len(hit), len(lines) - len(set(lines)))
        if words:
            assert (got.word_chars, got.n_symbols) == (sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)))
    assert supervision.judge(odd).count() == len(ODD) and supervision.judge(odd.limit(0)).count() == 0


def test_secrets(spark, odd):
    key = "AKIA" + "Z" * 16
    df = spark.createDataFrame([(i, f"é password = abcdefgh{i} {key} and token=token: abcdefgh", f"s{i}", "en") for i in range(4)] + [(9, None, None, None)], "doc_id long, text string, source string, lang string")
    rows = {r.doc_id: r for r in secrets.find(df).collect()}
    assert rows[0].spans == "assign:2:22,access:23:43" and (rows[0].n_live, rows[0].n_example) == (1, 1)
    assert rows[9].spans == "" and rows[9].base_sha256 == __import__("hashlib").sha256(b"").hexdigest()
    assert secrets.find(odd).count() == len(ODD) and secrets.find(odd.limit(0)).count() == 0


def test_short_items_and_long_ones(spark):
    """Items of any length are found, short ones on word borders; one of over a megabyte too."""
    long = " ".join(f"w{i}" for i in range(180_000))
    items = [(1, "2+2"), (2, "what is 9 times 7?"), (3, "a b"), (4, long), (5, "Ünit"), (5, " ünit "), (6, " \n")]
    texts = [(1, "so 2+2 is"), (2, "12+2 or 2+23"), (3, "Q: What is\n9 times 7? A: 63"), (4, "x " + long + " y"), (5, "one ünit,"), (6, "bünit"), (7, "a b c a b"), (8, None)]
    df, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r.doc_id, r.item_id) for r in decontaminate.matches(df, bench).collect())
    assert got == {(1, 1): 1, (3, 2): 1, (4, 4): 1, (5, 5): 2, (7, 3): 2}
    spans = {(r.start, r.end, r.n_edits, r.item_length) for r in decontaminate.matches(df, bench).where("doc_id = 5").collect()}
    assert spans == {(4, 9, 0, 5)}
    assert sorted(r.doc_id for r in decontaminate.clean(df, bench).collect()) == [2, 6, 8]


def edit_distance(item, text):
    """Edits of the best place of the whole item in the text, cell by cell."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        fresh = [i]
        for j, d in enumerate(text, 1):
            fresh.append(min(row[j - 1] + (c != d), row[j] + 1, fresh[-1] + 1))
        row = fresh
    return min(row)


def test_edits_equal_brute_force():
    draw = np.random.default_rng(4)
    letters = list("abcde ")
    items = [(i, "".join(draw.choice(letters, n)).strip().encode() + b"z") for i, n in enumerate((60, 90, 130))]
    items = [(i, decontaminate.collapse(t.decode())) for i, t in items]
    block, texts = decontaminate.Block(items, 0.05), []
    for _ in range(150):
        i, t = items[draw.integers(3)]
        body = list(t.decode())
        for _ in range(draw.integers(0, 8)):
            at = int(draw.integers(len(body)))
            kind = draw.integers(3)
            body[at : at + (kind != 0)] = [] if kind == 1 else ["q"]
        texts.append("".join(draw.choice(letters, 40)) + "".join(body) + "".join(draw.choice(letters, 30)))
    got = {}
    for d, i, _, _, n, _ in block.matches(texts):
        got[d, i] = min(n, got.get((d, i), 99))
    want = {}
    for d, t in enumerate(texts):
        for j, (i, item) in enumerate(items):
            n = edit_distance(item, decontaminate.collapse(t))
            if n <= block.budget[j]:
                want[d, i] = n
    assert len(want) > 40 and got == want


def test_pseudonyms_invert(spark, odd):
    text = "call +1 (366) 555-9807, pay 4041894974608795 from 42.144.35.254 on 2024-02-29 or 31/12/1999; bob.42@mail8.example.com 078-05-1120 GB82 WEST 1234 5698 7654 32"
    fresh, counts = pii.pseudonymise(text, b"k")
    assert set(counts.values()) <= {1, 2} and sum(counts.values()) == 8
    assert not any(x in fresh for x in ("366", "4041894974608795", "42.144", "2024-02-29", "bob", "078-05"))
    assert pii.pseudonymise(fresh, b"k", back=True)[0] == text
    assert pii.pseudonymise("1234567890123456 999.1.1.1 2023-02-30", b"k")[0] == "1234567890123456 999.1.1.1 2023-02-30"
    assert pii.mask(odd, b"k").count() == len(ODD)


def test_pseudonyms_of_every_kind_invert():
    import datetime as dt
    import random

    draw, key = random.Random(2), b"k"
    digits = lambda n: "".join(draw.choice("0123456789") for _ in range(n))

    def card():
        body = draw.choice("123456789") + digits(draw.choice([12, 14, 15]) - 1)
        return body + str(-pii.luhn(body + "0") % 10)

    def iban():
        land, body = draw.choice(["GB", "DE"]), "".join(draw.choice("ABCD0123456789") for _ in range(18))
        check = 98 - int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
        return f"{land}{check:02}{body}"

    def day():
        d = dt.date.fromordinal(draw.choice([draw.randrange(1, 3_600_000), draw.randrange(693_596, 766_645)]))
        return draw.choice([d.isoformat(), f"{d.day:02}/{d.month:02}/{d.year:04}", f"{d.day}.{d.month}.{d.year:04}", f"{d.month:02}/{d.day:02}/{d.year:04}", f"{d.day:02}/{d.month}/{d.year:04}"])

    made = {
        "card": card, "iban": iban, "date": day, "ip": lambda: ".".join(str(draw.randrange(256)) for _ in range(4)),
        "phone": lambda: draw.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"+{draw.randrange(2, 99)} {digits(3)} {digits(4)}", f"+4{digits(11)}"]),
        "ssn": lambda: f"{draw.randrange(1, 666):03}-{draw.randrange(1, 100):02}-{draw.randrange(1, 10**4):04}",
        "email": lambda: draw.choice([digits(16), digits(13), "a.b" + digits(4), "X" * 70, card(), "it+tag"]) + "@mail.example.org",
    }
    for kind, make in made.items():
        values = sorted({make() for _ in range(1500)})
        fresh = {}
        for v in values:
            text, counts = pii.pseudonymise(f"x {v}, y", key)
            assert counts[kind] == 1 and sum(counts.values()) == 1, (kind, v, text)
            assert pii.pseudonymise(text, key, back=True)[0] == f"x {v}, y"
            assert len(text) == len(f"x {v}, y") or kind == "ip"
            fresh[v] = text
        assert len(set(fresh.values())) == len(values)
    days = [pii.pseudonymise(t, key)[0] for t in ("1/2/2024", "01/02/2024", "1.2.2024", "2024-02-01", "02-01-2024")]
    parts = [sorted(map(int, re.split(r"[./-]", d))) for d in days[:4]]
    assert all(p == parts[0] for p in parts) and days[4] != days[1].replace("/", "-")  # the last is the 2nd of January
    assert pii.pseudonymise("13/02/2024", key)[0].split("/")[::-1] == pii.pseudonymise("2024-02-13", key)[0].split("-")


def test_chat_keeps_maximal(spark):
    rows = [(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (4, 0, "user", "c"), (4, 0, "user", "c"), (None, 0, "user", "z"), (5, None, None, None)]
    got = {(r.conv_id, r.n_turns, r.rendered) for r in chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {(2, 2, "<|user|>\na\n<|assistant|>\nb\n"), (4, 1, "<|user|>\nc\n"), (None, 1, "<|user|>\nz\n"), (5, 1, "<||>\n\n")}


def test_chat_counts_turns(spark):
    """Writers number turns in their own way; an opening marker in a text is no turn; fields do not run into each other."""
    rows = [(1, 0, "user", "a"), (2, 1, "user", "a"), (2, 7, "bot", "b"), (3, 5, "user", "a"), (3, 6, "bot", "b"), (3, 2000, "user", "c"), (4, 0, "us", "er\0a"), (5, 0, "us\0er", "a"), (6, 0, "user", "x<|bot|>y"), (7, -3, "user", "a"), (7, 4000, "bot", "b"), (7, 4001, "user", "d")]
    got = {(r.conv_id, r.n_turns): r.rendered for r in chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {(3, 3), (4, 1), (5, 1), (6, 1), (7, 3)}
    assert got[6, 1] == "<|user|>\nx<\\|bot|>y\n"


def test_subsequence_kernel_equals_brute_force():
    from itertools import combinations

    def phi(word):
        s, out = "\1" + word + "\2", Counter()
        for at in combinations(range(len(s)), 4):
            if at[3] - at[0] < toxicity.SPAN:
                out["".join(s[i] for i in at)] += toxicity.DECAY ** (at[3] - at[0] + 1)
        return out

    words = ["idiot", "id*iot", "idiiot", "clown", "ab", "aaaaaa", "worthless"]
    r, c, w = toxicity.subsequences(words)
    mine = np.zeros((len(words), toxicity.CODES), np.float32)
    mine[r, c] = w
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            x, y = phi(a), phi(b)
            dot = sum(x[k] * y[k] for k in x)
            norm = (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5
            assert abs(mine[i] @ mine[j] - dot / norm) < 1e-4


def test_sentences_and_their_windows():
    found = toxicity.sentences_of(pa.array(["You id iot! See i d i o t\nfoo-bar. x", None, "a.b.c "], pa.string()))
    units, unit, sentence = found.windows()
    per = {}
    for u, s in zip(unit, sentence):
        per.setdefault((int(found.text[s]), int(s)), set()).add(units[u])
    got = [per[k] for k in sorted(per)]
    assert got == [{"you", "id", "iot", "youid", "idiot"}, {"see", "i", "d", "o", "t", "seei", "id", "di", "io", "ot", "idiot"}, {"foo-bar", "foobar"}, {"x"}, {"a.b.c", "abc"}]
    assert found.n_texts == 3


def test_gapped_and_broken_insults_are_found():
    import random

    draw = random.Random(5)
    word = lambda: "".join(draw.choices("aeiounrstl", k=draw.randrange(3, 9)))
    clean = lambda: " ".join([*(word() for _ in range(10)), "you", word(), "such a", word()]) + "."
    rows = [(" ".join(clean() for _ in range(6)), 0) for _ in range(300)]
    rows += [(" ".join([clean(), f"you {word()} {draw.choice(['blockhead', 'pigswill'])} {word()}.", clean(), f"such a {draw.choice(['blockhead', 'pigswill'])}!", clean()]), 1) for _ in range(300)]
    draw.shuffle(rows)
    model = toxicity.fit(rows)
    ways = ["blockhead", "blockxhead", "bl.ockhead", "block-head", "blokhead", "pigswilll", "p i g s w i l l", "b.l.o.c.k.h.e.a.d"]
    texts = [f"{clean()} you {w}. {clean()} what a {w}!" for w in ways]
    assert (model.scores(pa.array(texts)) >= 0.3).all()
    assert (model.scores(pa.array([" ".join(clean() for _ in range(6)) for _ in range(50)])) < 0.3).mean() > 0.95


def test_ranking_minimises_the_pairwise_loss():
    rows = [("good words in a row " * (3 + i % 7), 1) for i in range(60)] + [("##$$ !! " * (2 + i % 5), 0) for i in range(40)]
    model, x = ranking.fit(rows, rivals=len(rows)), np.array([ranking.features(t) for t, _ in rows])
    hot, y = model.one_hot(x).astype(float), np.array([v for _, v in rows])
    draw = np.random.default_rng(7)
    bad, good = np.flatnonzero(y == 0), np.flatnonzero(y == 1)
    pairs = list(zip(np.repeat(bad, len(rows)), draw.choice(good, len(bad) * len(rows))))
    loss = lambda w: sum(np.log1p(np.exp(-(hot[b] - hot[a]) @ w)) for a, b in pairs) + w @ w / 2
    best = loss(model.weights)
    for _ in range(5):
        assert loss(model.weights + draw.normal(0, 0.02, len(model.weights))) > best
    assert all((model.scores(x) >= 0.3) == (y == 1))


def test_estimation_equals_plain_python():
    import math
    import random

    draw = random.Random(3)
    truth = [draw.random() < 0.7 for _ in range(600)]
    odds = [[(0.05, 0.15, 0.8), (0.7, 0.2, 0.1)], [(0.1, 0.5, 0.4), (0.6, 0.3, 0.1)], [(0.2, 0.2, 0.6), (0.5, 0.2, 0.3)], [(0.1, 0.1, 0.8), (0.8, 0.1, 0.1)]]
    seen = [tuple(draw.choices((0, 1, 2), o[0 if t else 1])[0] for o in odds) for t in truth]
    patterns = Counter(seen)
    share, logs = supervision.estimate(np.array([*patterns]), np.array([*patterns.values()], float))
    post = {p: 0.05 if 0 in p else 0.95 for p in patterns}
    for _ in range(200):  # the same estimation, count by count
        n = sum(patterns.values())
        good = sum(post[p] * c for p, c in patterns.items())
        prior, table = (good + 1) / (n + 2), {}
        for r in range(4):
            for v in range(3):
                a = sum(post[p] * c for p, c in patterns.items() if p[r] == v)
                b = sum((1 - post[p]) * c for p, c in patterns.items() if p[r] == v)
                x = math.log((a + 1) / (good + 3)) - math.log((b + 1) / (n - good + 3))
                table[r, v] = max(x, 0) if v == 2 else min(x, 0) if v == 0 else x
        post = {p: 1 / (1 + math.exp(-(math.log(prior / (1 - prior)) + sum(table[r, v] for r, v in enumerate(p))))) for p in patterns}
    assert abs(share - prior) < 1e-6 and all(abs(logs[r, v] - x) < 1e-6 for (r, v), x in table.items())
    assert np.mean([(post[s] >= 0.5) == t for s, t in zip(seen, truth)]) > 0.85


def test_ownership_equals_brute_force(spark, docs):
    rows = {r.doc_id: r for r in secrets.find(docs).collect()}
    table_ = docs.collect()
    found = {r.doc_id: secrets.scan(r.text or "") for r in table_}
    holders, stores = {}, {}
    for r in table_:
        for *_, value in found[r.doc_id]:
            holders.setdefault(value, set()).add(r.source)
            stores.setdefault(value, set()).add((r.source, r.lang))
    for r in table_:
        live = [len(holders[v]) <= 2 and len(stores[v]) <= 4 for *_, v in found[r.doc_id]]
        shown = [f"{secrets.KINDS[k]}:{a}:{b}" for (k, a, b, _), ok in zip(found[r.doc_id], live) if ok or k < 3]
        assert rows[r.doc_id].spans == ",".join(shown) and rows[r.doc_id].n_live == sum(live)
    spread = [(i, f"token = sharedvalue99 password: own{i}secret", f"s{i % 2}", f"l{i}") for i in range(6)]
    got = secrets.find(spark.createDataFrame(spread, "doc_id long, text string, source string, lang string")).collect()
    assert {(r.n_live, r.n_example, r.n_owners, r.n_repos) for r in got} == {(1, 1, 2, 6)}


def test_classifiers_hold_out():
    import duckdb

    rows = duckdb.sql("select doc_id, text, quality, toxic from '/root/testdata/sf0.01/documents.parquet' join '/root/testdata/sf0.01/labels.parquet' using (doc_id) order by doc_id").fetchall()
    held = [r for r in rows if r[0] % 4 == 0]
    model = ranking.fit([(t, q) for i, t, q, _ in rows if i % 4])
    said = model.scores(np.array([ranking.features(r[1]) for r in held])) >= 0.3
    assert np.mean(said == [bool(r[2]) for r in held]) > 0.95
    model = toxicity.fit([(t, x) for i, t, _, x in rows if i % 4])
    said, toxic = model.scores(pa.array([r[1] for r in held])) >= 0.3, np.array([bool(r[3]) for r in held])
    assert np.mean(said == toxic) > max(0.9, np.mean(~toxic) + 0.02) and np.mean(said[toxic]) > 0.5
    assert ((s := model.scores(pa.array(["", "\n", None], pa.string()))) >= 0).all() and (s <= 1).all()
