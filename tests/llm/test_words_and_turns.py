"""Fingerprints, spelling variants and conversation repair against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from postlens.llm import fingerprints, queries, repair, spelling
from tests.llm import brute

DATA = "/root/testdata/sf0.001"


def shingles(text, width=5):
    words = brute.WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_likeness_is_close_to_jaccard():
    rng, errors = random.Random(5), []
    for n in (3, 8, 20, 60, 300, 3000):
        for share in (0.0, 0.01, 0.05, 0.3):
            words = [f"w{rng.randrange(9999)}" for _ in range(n)]
            other = [f"v{rng.randrange(9999)}" if rng.random() < share else w for w in words]
            a, b = " ".join(words), " \t".join(other).upper()
            errors.append(fingerprints.likeness(fingerprints.fingerprint(a), fingerprints.fingerprint(b)) - jaccard(a, b))
    assert max(map(abs, errors)) < 0.13 and abs(sum(errors) / len(errors)) < 0.02
    unlike = [fingerprints.likeness(fingerprints.fingerprint(f"one{i}"), fingerprints.fingerprint(f"two{i}")) for i in range(50)]
    assert max(unlike) < 0.1, "texts of one shingle fill all bins with it"


def test_every_bin_is_filled_from_its_own_order():
    import numpy as np

    for n in (1, 5, 40, 500):
        filled = np.zeros(fingerprints.BINS, bool)
        filled[np.random.default_rng(n).choice(fingerprints.BINS, n, replace=False)] = True
        least = np.where(filled, np.arange(fingerprints.BINS), -1).astype(np.uint64)
        found = fingerprints.fill(least.copy(), filled)
        for b in range(fingerprints.BINS):
            want = b if filled[b] else next(int(d) for d in fingerprints.ORDER[b] if filled[d])
            assert found[b] == want


def test_blocks_do_not_change_fingerprints(monkeypatch):
    from postlens.llm import simhash

    text = " ".join(f"word{i % 700}" for i in range(5000))
    whole = fingerprints.fingerprint(text)
    monkeypatch.setattr(simhash, "BLOCK_BYTES", 50)
    assert fingerprints.fingerprint(text) == whole


def plain_edits(rows):
    """(id, n_chars, sha) by descending id, as the contract says, for rows of distinct ids."""
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    for i, (key, text) in enumerate(ordered):
        following = ordered[(i + 1) % len(ordered)][1] or ""
        text = text or ""
        cut = len(text) // 3
        yield key, len(text), text[: len(text) - cut] + following[:cut], text, following


def test_edited_texts(spark, shared):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(9001, None), (9002, ""), (9003, "ab"), (9004, "Ünï 😀 x" * 9), (None, "no id here"), (-5, "x y " * 30000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"_llm_id": F.lit(1), "fingerprint": F.lit("x")}).repartition(7)
    got = {r["doc_id"]: r for r in fingerprints.against_edits(df).collect()}
    assert len(got) == len(docs)
    for key, n, changed, text, following in plain_edits(docs):
        row = got[key]
        assert (row["n_chars"], row["edited_sha256"]) == (n, brute.sha(changed))
        assert bytes(row["fingerprint"]) == fingerprints.fingerprint(text) and bytes(row["edited_fingerprint"]) == fingerprints.fingerprint(changed)
        assert abs(row["near_edited"] - jaccard(text, changed)) < 0.13 and abs(row["near_next"] - jaccard(text, following)) < 0.13
    one = fingerprints.against_edits(df.where("doc_id = 9003")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert fingerprints.against_edits(df.limit(0)).count() == 0


def test_edited_rows_of_one_id(spark, awkward):
    assert fingerprints.against_edits(awkward).count() == awkward.count()
    marked = fingerprints.with_fingerprints(awkward)
    assert marked.columns.count("fingerprint") == 1 and marked.count() == awkward.count()
    near = fingerprints.with_likeness(marked.crossJoin(marked.limit(1).select(F.col("fingerprint").alias("f2"))), "fingerprint", "f2")
    assert all(0 <= r["likeness"] <= 1 for r in near.collect())


def plain_words(rows, damage, least_chars, least):
    total = Counter()
    for key, text in rows:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m.group().lower(), word)
            h = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
            if damage and h % damage == 0:
                k = h % len(word)
                word = word[:k] + word[k + 1 :]
            if len(word) >= least_chars:
                total[word] += 1
    return {w: n for w, n in total.items() if n >= least}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_forms(count):
    """The answer by deletions: two words at one edit share a word with one place wild or gone."""
    spots = defaultdict(set)
    for w in count:
        spots[w].add(w)
        for i in range(len(w)):
            spots[w[:i] + w[i + 1 :]].add(w)
            spots[w[:i] + "*" + w[i + 1 :]].add(w)
    near = defaultdict(set)
    for group in spots.values():
        for a, b in combinations(group, 2):
            if one_edit(a, b):
                near[a].add(b)
                near[b].add(a)
    form = {}
    for w, n in count.items():
        best = min(near[w], key=lambda x: (-count[x], x), default=None)
        form[w] = best if best is not None and count[best] >= 2 * n else None
    for w, n in count.items():
        root = w
        while form[root] is not None:
            root = form[root]
        yield w, n, len(near[w]), form[w], count[form[w]] if form[w] else None, root


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_spelling_query(spark, shared, folder):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = {(r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in queries.spelling_variants(spark, folder).collect()}
    assert got == set(plain_forms(plain_words(rows, 97, 5, 3)))


def test_spelling_of_dense_words(spark, shared, monkeypatch):
    """Few letters, short words, a low bound of frequency: long grams, bounds at their limits, repeated grams."""
    monkeypatch.setattr(spelling, "SHARE", 1e-3)
    rng = random.Random(4)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 9))) for _ in range(1500)}
    count = {w: rng.randint(1, 50) for w in words}
    df = spark.createDataFrame(list(count.items()), "word string, n long").withColumn("form", F.lit(1)).repartition(3)
    got = {(r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in spelling.variant_forms(df).collect()}
    assert got == set(plain_forms(count))
    assert spelling.variant_forms(df.limit(0)).count() == 0


def test_no_edit_changes_more_grams_than_the_bound():
    rng = random.Random(8)
    for trial in range(30):
        words = ["".join(rng.choice("abc") for _ in range(rng.randint(2, 10))) for _ in range(80)]
        grams = {}
        for w in words:
            s = spelling.LEFT + w + spelling.RIGHT
            for q in (2, 3, 4):
                for i in range(len(s) - q + 1):
                    if q == 2 or rng.random() < 0.5:
                        grams[s[i : i + q]] = 1
        index = spelling.Index(grams)
        for w in words[:20]:
            s = spelling.LEFT + w + spelling.RIGHT
            starts, ends = index.decompose(s)
            bound = index.bound(s, starts, ends)
            mine = list(zip(starts, ends))
            for i in range(len(w) + 1):
                for new in [w[:i] + c + w[i:] for c in "abcd"] + ([w[:i] + c + w[i + 1 :] for c in "abcd"] + [w[:i] + w[i + 1 :]] if i < len(w) else []):
                    t = spelling.LEFT + new + spelling.RIGHT
                    theirs = set(zip(*index.decompose(t)))
                    at, shift = i + len(spelling.LEFT), len(t) - len(s)
                    lost = sum((p, e) not in theirs if e <= at else (p + shift, e + shift) not in theirs or p < at + (shift <= 0) for p, e in mine)
                    assert lost <= bound


def test_words_of_awkward_tables(spark, awkward, nothing):
    got = {r["word"]: r["n"] for r in spelling.count_words(awkward, "[A-Za-zÀ-ÿ]+", damage=3).collect()}
    assert got == plain_words([(r["doc_id"], r["text"]) for r in awkward.collect()], 3, 1, 1)
    assert spelling.count_words(nothing, "[a-z]+").count() == 0


FAULTS = ("blank", "duplicate", "truncated")


def plain_repair(rows):
    """Counts, least (cost, audit) left to right over states, and the repaired turns, for rows (turn, role, text) in order."""
    counts, marks, seen = Counter(), [], set()
    for _, role, text in rows:
        said = [c for c in text if c not in " \t\n\x0b\x0c\r"]
        mark = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else ""
        seen.add((role, text))
        marks.append(mark)
        counts[mark] += 1
    initials = [r[1][:1] for r in rows]
    step = {("0", "s"): "1", ("0", "u"): "2", ("1", "u"): "2", ("3", "u"): "2", ("2", "a"): "3"}

    def insertions(best):
        for _ in range(4):
            for state, (cost, audit, turns) in list(best.items()):
                for role in "ua":
                    to = step.get((state, role))
                    if to and (to not in best or (cost + 2, audit + "I") < best[to][:2]):
                        best[to] = (cost + 2, audit + "I", [*turns, ({"u": "user", "a": "assistant"}[role], "")])
        return best

    best = insertions({"0": (0, "", [])})
    for (_, role, text), mark, first in zip(rows, marks, initials):
        after = {}

        def offer(state, cost, audit, turns):
            if state not in after or (cost, audit) < after[state][:2]:
                after[state] = (cost, audit, turns)

        for state, (cost, audit, turns) in best.items():
            offer(state, cost + 3, audit + "D", turns)
            if mark in ("", "truncated"):
                extra = mark == "truncated"
                if (state, first) in step:
                    offer(step[state, first], cost + extra, audit + "K", [*turns, (role, text)])
                for new in "ua":
                    if (state, new) in step:
                        offer(step[state, new], cost + extra + 2, audit + "R", [*turns, ({"u": "user", "a": "assistant"}[new], text)])
        best = insertions(after)
    cost, audit, turns = min((best[s] for s in "03" if s in best), key=lambda x: x[:2])
    numbers = [r[0] for r in rows if r[0] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()
    return (gaps, *(counts[f] for f in FAULTS), illegal, cost, audit, sha)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def plain_damage(rows):
    made = defaultdict(list)
    for key, turn, role, text in rows:
        made[key]
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if key is None else key}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        made[key] += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    for rows in made.values():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    return made


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_repair_query(spark, shared, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {tuple(r[c] for c in COLUMNS) for r in queries.conversation_repair(spark, folder).collect()}
    assert got == {(key, *plain_repair(turns)) for key, turns in plain_damage(rows).items()}


def test_repair_of_awkward_turns(spark, shared, tmp_path):
    rng = random.Random(6)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "under"], ["Yes.", "No!", "cut", "", " \n", None, "Why? ", "x.\t"]
    rows = [(c, t, rng.choice(roles), f"{rng.choice(texts) or ''}{rng.choice(['', t, '.'])}" or None) for c in range(40) for t in rng.sample(range(12), rng.randint(1, 9))]
    rows += [(None, t, rng.choice(roles[:3]), f"Said {t}.") for t in range(6)] + [(77, None, "user", "No number.")] + [(78, t, None, None) for t in range(3)]
    rows += [(79, t, rng.choice(roles[:3]), rng.choice(["Hm.", "", f"Text {t}", f"Text {t}."])) for t in range(700)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"at": F.lit("x"), "part": F.lit(1)}).repartition(6)
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {tuple(r[c] for c in COLUMNS) for r in queries.conversation_repair(spark, str(tmp_path)).collect()}
    want = {(key, *plain_repair(turns)) for key, turns in plain_damage(rows).items()}
    assert got == want
    whole, repaired = repair.repair(df.limit(0))
    assert whole.count() == repaired.count() == 0


def test_cells_of_any_split_are_equal():
    rng = random.Random(1)
    for _ in range(200):
        cells = [repair.CELLS[rng.choice(["s", "u", "a", ""]), rng.randrange(4)] for _ in range(rng.randint(1, 7))]
        table = {(i, i + 1): cell for i, cell in enumerate(cells)}
        for size in range(2, len(cells) + 1):
            for i in range(len(cells) - size + 1):
                made = [repair.combine(table[i, k], table[k, i + size]) for k in range(i + 1, i + size)]
                assert all(cell == made[0] for cell in made)
                table[i, i + size] = made[0]
        assert repair.parse(cells) == table[0, len(cells)]
