"""Source divergence, benchmark decontamination and conversation repair against plain versions."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from terrazzo.llm import conversations, decontaminate, divergence

ODD_NAMES = "doc_id long, text string, lang string, source string, `a.b` string, size long, term string, starts string, items string, _p string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# -- source divergence


def plain_audit(rows):
    """(lang, source, part, item, value, rank) of (text, lang, source) rows."""
    counts, held, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))
        counts[lang, source].update(terms)
        held[lang].update(set(terms))
        groups.add((lang, source))
    out = set()
    for lang in {g for g, _ in groups}:
        kept = sorted(t for t, n in held[lang].items() if n >= 3)
        sources = sorted(s for g, s in groups if g == lang)

        def shares(c):
            size = sum(c[t] for t in kept)
            return [1 + 1_000_000_000 * (c[t] + 1) // (size + len(kept)) for t in kept]

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = sorted((-sum((a - b) ** 2 // b for a, b in zip(p[s], p[o])), o) for o in sources if o != s)
            terms = sorted((-((a - b) ** 2 // b), t) for a, b, t in zip(p[s], q, kept) if counts[lang, s][t] and a > b)[:200]
            out |= {(lang, s, "pair", o, -v, i + 1) for i, (v, o) in enumerate(pairs)}
            out |= {(lang, s, "term", t, -v, i + 1) for i, (v, t) in enumerate(terms)}
    return out


def audited(df):
    rows = [tuple(r) for r in divergence.audit_sources(df).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_audit_equals_a_plain_count(spark, odd):
    rows = [(r.text, r.lang, r.source) for r in odd.collect()]
    assert audited(odd) == plain_audit(rows)


def test_audit_in_small_slices_shards_and_tiles(spark, monkeypatch):
    rng = random.Random(3)
    words = ["alpha", "Beta", "GAMMA", "été", "straße", "日本", "x1y", "a-b", "delta", "eps"]
    rows = [(i, " ".join(rng.choice(words[: rng.randint(1, 10)]) for _ in range(rng.randint(0, 30))), rng.choice(["en", "de", "", None]), f"s{rng.randint(0, 6)}", "x", 1, "t", "u", "v", "w") for i in range(200)]
    df = spark.createDataFrame(rows, ODD_NAMES).repartition(5)
    for name, value in (("SLICE_BYTES", 300), ("HELD_COUNTS", 10), ("SHARD_COUNTS", 5), ("CELLS", 12), ("BROADCAST_ROWS", 0), ("SALTS", 3)):
        monkeypatch.setattr(divergence, name, value)
    assert audited(df) == plain_audit([r[1:4] for r in rows])


def test_audit_of_no_rows_and_of_no_terms(spark, none):
    assert audited(none) == set()
    df = spark.createDataFrame([(1, None, None, "a"), (2, "12 34", None, "b"), (3, "", "en", None)], "doc_id long, text string, lang string, source string")
    assert audited(df) == {("", "a", "pair", "b", 0, 1), ("", "b", "pair", "a", 0, 1)}


def test_audit_of_many_terms_ranks_two_hundred(spark):
    terms = [f"{a}{b}" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrst"]
    rows = [(i, " ".join(terms), "en", "one") for i in range(3)] + [(9 + i, "zz " * 5, "en", "two") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = audited(df)
    assert got == plain_audit([r[1:] for r in rows])
    assert max(r[5] for r in got if r[2] == "term") == 200


# -- decontamination


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def plain_hits(text, items, size):
    """(n_words, hit places, ids of items with windows)."""
    w = words_of(text)
    hit, ids = set(), set()
    for item_id, item in items:
        v = words_of(item)
        n = min(size, len(v))
        windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n and item_id is not None else 0):
            if tuple(w[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                ids.add(item_id)
    return len(w), hit, ids


def random_texts(seed, n, most, words="abcde"):
    rng = random.Random(seed)
    return [" ".join(rng.choice(words) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_words_of_pieces_are_the_texts_words(monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE_BYTES", 7)
    for text in ["", None, "  ", "Hello, World_x [y] 12\x00é日本-a", "a" * 30, "x y " * 40, "\x7fend"]:
        assert [w.decode() for piece in decontaminate.split_words(text) for w in piece] == words_of(text)


@pytest.mark.parametrize("numbers", [2, 5, 100_000])
def test_suffix_array_is_in_order(numbers):
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 300):
        text = rng.integers(0, numbers, n)
        order = decontaminate.suffix_array(text, n + 1)
        assert [text[i:].tolist() for i in order] == sorted(text[i:].tolist() for i in range(n))


@pytest.mark.parametrize(("size", "block_words", "shard"), [(3, 1 << 19, 1 << 20), (3, 12, 20), (10, 1 << 19, 50), (10, 1, 1)])
def test_contamination_equals_plain_search(spark, monkeypatch, size, block_words, shard):
    items = [(i, t) for i, t in enumerate(random_texts(1, 12, 25))] + [(50, "B a"), (51, None), (None, "a b c d e a b c d e"), (52, "zz"), (7, "e d c b a e d c b a"), (52, "zz")]
    docs = [(i, t) for i, t in enumerate(random_texts(2, 60, 80))] + [(70, None), (71, "zz"), (71, "q q q"), (None, "b A!"), (72, items[3][1]), (73, "x " * 5000 + (items[4][1] or "") + " x" * 5000)]
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", shard)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_words, sorted(p for a, b in zip(r.starts, r.ends) for p in range(a, b)), list(r.items)) for r in decontaminate.contamination(df, tests, size, block_words).collect()), key=str)
    want = []
    for doc_id, text in docs:
        n, hit, ids = plain_hits(text, items, size)
        want.append((doc_id is None, doc_id or 0, n, sorted(hit), sorted(ids)))
    assert got == sorted(want, key=str)


def test_spans_of_a_long_item_hold_all_windows(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SPAN_WORDS", 7)
    items = [(1, random_texts(4, 1, 60)[0] + " a b c d e f g"), (2, "a b c d")]
    docs = [(i, t) for i, t in enumerate(random_texts(5, 40, 60))] + [(90, items[0][1])]
    found = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 4)
    got = {r.doc_id: (sum(b - a for a, b in zip(r.starts, r.ends)), set(r.items)) for r in found.collect()}
    assert got == {d: (len(h), ids) for d, t in docs for _, h, ids in [plain_hits(t, items, 4)]}


def test_longest_matches_are_the_longest(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 100)
    items, docs = list(enumerate(random_texts(6, 5, 20))), list(enumerate(random_texts(7, 30, 60)))
    got = {(r.item_id, r.item_start): (r.length, r.doc_id, r.doc_start) for r in decontaminate.longest_matches(spark.createDataFrame(docs, "doc_id long, text string").repartition(2), spark.createDataFrame(items, "item_id long, text string"), 3).collect()}
    all_docs = {d: words_of(t) for d, t in docs}
    for i, text in items:
        v = words_of(text)
        for at in range(len(v)):
            best = max(next((k for k in range(len(v) - at + 1) if w[s + k : s + k + 1] != v[at + k : at + k + 1] or at + k == len(v)), 0) for w in all_docs.values() for s in range(len(w)))
            if best < 3:
                assert (i, at) not in got
            else:
                length, d, s = got[i, at]
                assert length == best and all_docs[d][s : s + best] == v[at : at + best]


def test_affected_documents_go_with_any_columns(spark, none):
    item = "one two three four five six seven eight nine ten eleven"
    rows = [(1, f"before {item.upper()} after", "en", "s", "x", 1, "t", "u", "v", "w"), (2, "clean", None, None, None, None, None, None, None, None), (None, item, "en", "s", "y", 2, "t", "u", "v", "w")]
    df = spark.createDataFrame(rows, ODD_NAMES)
    tests = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = decontaminate.drop_contaminated(df, tests)
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} == {2, None}
    assert decontaminate.contamination_digest(none, tests).count() == 0
    empty = decontaminate.contamination_digest(df, tests.limit(0)).collect()
    assert {(r.n_hit, r.n_items, r.contaminated, r.items_sha256) for r in empty} == {(0, 0, False, hashlib.sha256(b"").hexdigest())}


# -- conversations


def plain_repair(rows):
    """(cost, audit, repaired) of (role, text, fault) rows, by trying all edits, with up to two insertions at each place."""
    best = None
    choices = [[e for e in ("K", "Ru", "Ra", "D") if e == "D" or f not in (1, 2)] for _, _, f in rows]
    for edits in itertools.product(*choices):
        for ins in itertools.product(("", "u", "a", "ua", "au"), repeat=len(rows) + 1):
            cost, audit, out = 0, "", []
            for i in range(len(rows) + 1):
                for x in ins[i]:
                    cost, audit = cost + 5, audit + "I"
                    out.append((x, {"u": "user", "a": "assistant"}[x] + ":"))
                if i < len(rows):
                    (role, text, fault), e = rows[i], edits[i]
                    cost += {"K": 0, "R": 1, "D": 2}[e[0]] + (5 if fault == 3 and e != "D" else 0)
                    audit += e[0]
                    if e != "D":
                        new = role if e == "K" else {"u": "user", "a": "assistant"}[e[1]]
                        out.append((new[:1], f"{new}:{text}"))
            if re.fullmatch("(s?(ua)+)?", "".join(x or "-" for x, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, "\n".join(t for _, t in out)
    return best


def repair_of(parser, rows):
    c = conversations._Conversation(parser, 1)
    found = [(e, top, *best) for e in [0] for top, best in parser.piece([(r[:1], f) for r, _, f in rows], e).items()]
    c.pieces = [dict(zip(("entry", "top", "cost", "audit"), zip(*found)))] if rows else []
    out = [t for role, text, _ in rows for t in c.row(None, role, text)] + list(c.inserts())
    return c.cost, c.audit, "\n".join(f"{t[4]}:{t[5]}" for t in out)


def test_parser_equals_all_edits():
    parser, rng = conversations.Parser(), random.Random(9)
    cases = [[]] + [[(rng.choice(["user", "assistant", "system", "tool", "", "umpire"]), "t", rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(1, 3))] for _ in range(120)]
    for rows in cases:
        assert repair_of(parser, rows) == plain_repair(rows)


def viterbi(rows):
    """(cost, audit, repaired) by the states of the grammar's automaton, for any length."""
    turn = {0: "user", 1: "user", 2: "assistant", 3: "user"}
    nodes = {0: (0, "", [])}

    def inserted(nodes):
        nodes = dict(nodes)
        for _ in range(4):
            for s, (c, a, o) in list(nodes.items()):
                to = 3 if s == 2 else 2
                new = (c + 5, a + "I", o + [turn[s] + ":"])
                if to not in nodes or new[:2] < nodes[to][:2]:
                    nodes[to] = new
        return nodes

    for role, text, fault in rows:
        out = {}
        for s, (c, a, o) in inserted(nodes).items():
            moves = [(s, 2, "D", [])]
            if fault not in (1, 2):
                more = 5 if fault == 3 else 0
                to = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}.get((s, role[:1]))
                if to is not None:
                    moves.append((to, more, "K", [f"{role}:{text}"]))
                moves.append((3 if s == 2 else 2, 1 + more, "R", [f"{turn[s]}:{text}"]))
            for to, cost, e, new in moves:
                cand = (c + cost, a + e, o + new)
                if to not in out or cand[:2] < out[to][:2]:
                    out[to] = cand
        nodes = out
    c, a, o = min((v for s, v in inserted(nodes).items() if s in (0, 3)), key=lambda v: v[:2])
    return c, a, "\n".join(o)


def plain_report(rows):
    """Report rows of (conv_id, turn, role, text) that stay after damage, and of all ids."""
    after, ids = defaultdict(list), {r[0] for r in rows}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h:
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            after[conv] += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    out = set()
    for conv in ids:
        seen, turns, faults = set(), [], []
        of = sorted(after[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        for turn, role, text in of:
            end = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append(1 if not end else 2 if (role, text) in seen else 3 if end[-1] not in ".!?" else 0)
            seen.add((role, text))
            turns += [] if turn is None else [turn]
        cost, audit, text = viterbi([(r, t, f) for (_, r, t), f in zip(of, faults)])
        initials = [r[:1] for _, r, _ in of]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.add((conv, gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return out


def odd_conversations():
    rng = random.Random(11)
    text = lambda: rng.choice(["Yes.", "No", " ", "", "Maybe?\n", None, "Fine!", "same text.", "Ende.\t "])
    role = lambda: rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
    rows = [(c, t, role(), text()) for c in range(40) for t in range(rng.randint(0, 6))]
    rows += [(None, t, role(), text()) for t in (3, 4, None)] + [(100, None, "user", "Hi."), (100, 5, "assistant", "Ho."), (100, 9, "user", "Hm.")]
    rows += [(200, t, ["user", "assistant"][(t + t // 7) % 2], f"turn {t}" + rng.choice([".", "!", ""])) for t in range(1500)]  # over several ranges
    rows += [(300, 1, "user", "again.")] * 50
    return rows


def test_report_equals_a_plain_repair(spark):
    rows = odd_conversations()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, `a.b` string, kind long").repartition(7)
    got = [tuple(r) for r in conversations.repair_report(conversations.damaged(df), df).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_report(rows)


def test_repaired_turns_are_those_of_the_digest(spark):
    df = spark.createDataFrame(odd_conversations(), "conv_id long, turn long, role string, text string")
    turns = defaultdict(list)
    for r in conversations.repaired(df).collect():
        turns[r.conv_id].append((r.place, f"{r.role}:{r.text}", r.edit, r.turn))
    for r in conversations.repair_report(df).collect():
        of = sorted(turns[r.conv_id])
        assert [p for p, *_ in of] == list(range(len(of)))
        assert hashlib.sha256("\n".join(t for _, t, _, _ in of).encode()).hexdigest() == r.repaired_sha256
        assert [e for _, _, e, _ in of] == [e for e in r.audit if e != "D"]


def test_report_of_no_rows(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.repair_report(none).count() == 0
    ids = spark.createDataFrame([(1,), (None,)], "conv_id long")
    assert {tuple(r) for r in conversations.repair_report(none, ids).collect()} == {(i, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for i in (1, None)}
