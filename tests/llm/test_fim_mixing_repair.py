"""Operators 11 to 13 against plain versions, exact round trips and invariants, and on odd tables."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from patrolkit.llm import fim, mixing, queries, repair

CONVERSATION = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- 11 fill-in-middle -----------------------------------------------------------------------------------------------


def plain_fim(doc_id, text, pattern=r"[^\n]*\n|[^\n]+"):
    text = text or ""
    units = re.findall(pattern, text)
    h = [int(sha(f"7:{'' if doc_id is None else doc_id}")[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def result(made):
    return made.units, made.form, made.prefix, made.middle, made.output


@given(st.text(alphabet="ab\n\r é日<PSM>", max_size=60), st.integers(-5, 10**12))
@settings(max_examples=300, deadline=None)
def test_fim_is_the_plain_split(text, doc_id):
    scan = fim.Scanner(fim.Units(), fim.Sentinels())
    made = fim.transform_text(text, fim.draws(7, str(doc_id)), scan)
    assert result(made) == plain_fim(doc_id, text)
    assert scan.restored(made.output, made.form) == text


@given(st.text(alphabet="ab c\n<PS>", max_size=60), st.integers(1, 5), st.integers(0, 10**6))
@settings(max_examples=300, deadline=None)
def test_fim_units_of_a_width(text, width, doc_id):
    """Gaps between events hold as many units as their lengths say, with any breaks."""
    for breaks in ("", "\n", " \n"):
        scan = fim.Scanner(fim.Units(breaks, width), fim.Sentinels())
        kept = f"[^{re.escape(breaks)}]" if breaks else r"[\s\S]"
        runs = re.findall(f"{kept}*[{re.escape(breaks)}]|{kept}+" if breaks else r"[\s\S]+", text)
        units = [run[i : i + width] for run in runs for i in range(0, len(run), width)]
        found = scan(text)
        assert found.units == len(units)
        assert [found.offset(k) for k in range(len(units) + 1)] == [len("".join(units[:k])) for k in range(len(units) + 1)]
        made = fim.transform_text(text, fim.draws(7, str(doc_id)), scan)
        assert scan.restored(made.output, made.form) == text


def test_fim_other_sentinels_and_rates():
    marks = fim.Sentinels("<PRE>", "<SUF>", "<MID>")
    scan = fim.Scanner(fim.Units(" "), marks)
    text = "one two <P> three four"
    assert fim.transform_text(text, fim.draws(7, "1"), scan, rate=0).form == "plain"
    for spm, form in ((0, "psm"), (100, "spm")):
        made = fim.transform_text(text, fim.draws(7, "1"), scan, spm=spm)
        assert made.form == form and scan.restored(made.output, form) == text
    for wrong in (("<P>", "<P>", "<M>"), ("P", "<S>", "<M>"), ("<P<>", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fim.Sentinels(*wrong)
    with pytest.raises(ValueError):
        fim.Units("é")


def test_fim_on_odd_tables(spark, odd_docs):
    got = fim.transform(odd_docs).collect()
    assert len(got) == odd_docs.count() and {"score", "row"} <= set(got[0].asDict())
    for r in got:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain_fim(r["doc_id"], r["text"])
    for r in fim.digests(odd_docs.withColumnRenamed("row", "n")).collect():
        assert r["n"] == "own" and "_n" in r.asDict()
    assert fim.digests(odd_docs.limit(0)).count() == 0


def test_fim_query(spark, sf):
    want = {}
    for r in queries.texts(spark, sf).collect():
        n, form, prefix, middle, output = plain_fim(r["doc_id"], r["text"])
        want[r["doc_id"]] = (n, form, prefix, middle, sha(output), sha(r["text"] or ""))
    got = queries.op11_fill_in_middle(spark, sf).collect()
    assert {r["doc_id"]: (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_sha256"], r["restored_sha256"]) for r in got} == want
    assert len({form for _, form, *_ in want.values()}) >= 2


# ---- 12 source mix ---------------------------------------------------------------------------------------------------


def plain_targets(sizes, weights=(5, 2, 1), most=3, share=1.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values()) * share
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        aims = {s: rest * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if aims[s] > most * sizes[s]}
        if not over:
            return aims | {s: most * sizes[s] for s in full}
        full |= over


@given(st.lists(st.integers(0, 1_000), min_size=1, max_size=12), st.booleans())
@settings(max_examples=4, deadline=None)
def test_mix_targets(spark, sizes, with_null):
    named = {(None if with_null and i == 0 else f"s{i}é"[: 1 + i % 3] + str(i)): n for i, n in enumerate(sizes)}
    table = spark.createDataFrame(list(named.items()), "source string, source_size long")
    got = {r["source"]: r for r in mixing.targets(table).collect()}
    want = plain_targets(named)
    assert set(got) == set(want)
    for s, aim in want.items():
        assert got[s]["target"] == pytest.approx(aim, rel=1e-12) and got[s]["target"] <= 3 * named[s] + 1e-9


@given(st.lists(st.tuples(st.integers(0, 50), st.floats(0, 1)), max_size=40), st.integers(0, 10**6))
@settings(max_examples=300, deadline=None)
def test_mix_flight_keeps_both_totals(units, seed):
    p = mixing.flight(units, random.Random(seed))
    between = [i for i, q in enumerate(p) if 0 < q < 1]
    assert len(between) <= 2
    assert sum(p) == pytest.approx(sum(q for _, q in units), abs=1e-6)
    assert sum(q * s for q, (s, _) in zip(p, units, strict=True)) == pytest.approx(sum(q * s for s, q in units), abs=1e-4)
    for landed in (mixing.land(units, p, random.Random(seed)), mixing.decide(units, random.Random(seed))):
        assert set(landed) <= {0.0, 1.0} and len(landed) == len(units)
        assert all(q == want for q, (_, want) in zip(landed, units, strict=True) if want in (0.0, 1.0))
    landed = mixing.land(units, p, random.Random(seed))
    assert all(landed[i] == p[i] for i in range(len(p)) if i not in between)
    off = abs(sum(q * s for q, (s, _) in zip(landed, units, strict=True)) - sum(q * s for s, q in units))
    assert off <= max([units[i][0] for i in between], default=0) + 1e-4


def test_mix_last_block_misses_by_a_short_document():
    """Lengths over four powers of ten: words within the shortest ones, documents within a few of the reserve."""
    for seed in range(40):
        draw = random.Random(seed)
        units = [(int(10 ** draw.uniform(0, 4)), 0.37) for _ in range(1_000)]
        got = mixing.decide(units, draw)
        assert abs(sum(q * s for q, (s, _) in zip(got, units, strict=True)) - 0.37 * sum(s for s, _ in units)) <= 5
        assert abs(sum(got) - 370) <= 8


def test_mix_keeps_inclusion_probabilities():
    units = [(s, q) for s, q in zip([9, 7, 5, 3, 3, 2, 1, 1], [0.3, 0.5, 0.7, 0.2, 0.9, 0.4, 0.6, 0.1], strict=True)]
    taken = [0.0] * len(units)
    for seed in range(6_000):
        draw = random.Random(seed)
        p = mixing.decide(units, draw, tries=1)
        taken = [t + q for t, q in zip(taken, p, strict=True)]
    assert all(t / 6_000 == pytest.approx(q, abs=0.03) for t, (_, q) in zip(taken, units, strict=True))


def docs_with_sources(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


@pytest.mark.parametrize("block", [8, 4_096])
def test_mix_meets_targets_in_any_blocks(spark, block):
    draw = random.Random(5)
    rows = [(i, "w " * draw.choice([1, 2, 3, 5, 8, 40, 300]), "hot" if i % 3 else draw.choice(["a", "b", "c", None, "d"])) for i in range(1_200)]
    rows += [(7_000, "same words here", "a")] * 200  # repeated rows are one unit
    docs = docs_with_sources(spark, rows)
    got = mixing.plan(docs, block=block).collect()
    sizes, count = Counter(), Counter((i, len((t or "").split())) for i, t, _ in rows)
    for _, t, s in rows:
        sizes[s] += len(t.split())
    assert Counter((r["doc_id"], r["size"]) for r in got) == count
    aims, taken = plain_targets(sizes), Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(aims[r["source"]])
        assert r["taken"] == r["times"] * r["size"] and 0 <= r["times"] <= 3
        wanted = aims[r["source"]] / sizes[r["source"]]
        assert int(wanted) <= r["times"] <= int(wanted) + 1
        taken[r["source"]] += r["taken"]
    off = 300 if block == 8 else 40  # a last block of eight units has no short ones in reserve
    assert all(abs(taken[s] - aims[s]) <= off for s in sizes)
    assert Counter(tuple(r) for r in mixing.plan(docs.repartition(7), block=block).collect()) == Counter(tuple(r) for r in got)
    mixed = Counter((r["doc_id"], r["text"]) for r in mixing.mixture(docs, block=block).collect())
    times = Counter()
    for r in got:
        times[r["doc_id"]] += r["times"]
    assert Counter({i: n for (i, _), n in mixed.items()}) == +times


def test_mix_on_odd_tables(spark, odd_docs):
    got = mixing.plan(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert all(r["size"] == 0 for r in got if r["doc_id"] in (1, 2)) and all(r["taken"] <= 3 * r["size"] for r in got)
    assert mixing.plan(odd_docs.limit(0)).count() == 0
    empty = docs_with_sources(spark, [(1, "", "a"), (2, None, None), (2, None, None)])
    assert sorted((r["doc_id"], r["target"], r["taken"]) for r in mixing.plan(empty).collect()) == [(1, 0.0, 0), (2, 0.0, 0), (2, 0.0, 0)]
    odd = docs_with_sources(spark, [(1, "\x1c  a\x0bb c\td", "a")])
    assert mixing.plan(odd).first()["size"] == 4


def test_mix_runs_of_one_unit(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN", 10)
    got = mixing.plan(docs_with_sources(spark, [(1, "a b", "s")] * 95 + [(2, "c", "t")] * 4)).collect()
    assert Counter(r["doc_id"] for r in got) == {1: 95, 2: 4}


def test_mix_query(spark, sf):
    got = queries.op12_source_mix(spark, sf).collect()
    docs = queries.table(spark, sf, "documents").collect()
    sizes = Counter()
    for r in docs:
        sizes[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    aims, taken = plain_targets(sizes), Counter()
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in docs)
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["taken"] <= 3 * r["size"] and r["target"] == pytest.approx(aims[r["source"]])
    longest = Counter()
    for r in got:
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    assert all(abs(taken[s] - aims[s]) <= max(0.03 * aims[s], longest[s] / 2) for s in sizes)  # ten documents a source
    taken, aims = Counter(), {}
    for r in queries.op12_source_mix(spark, "/root/testdata/sf0.01").collect():  # fifty
        taken[r["source"]] += r["taken"]
        aims[r["source"]] = r["target"]
    assert all(abs(taken[s] - aims[s]) <= 0.02 * aims[s] for s in aims)


# ---- 13 conversation repair ------------------------------------------------------------------------------------------

FORM = re.compile(r"(s?(ua)+)?\Z")


def plain_repair(rows):
    """Counts, cost, audit and repaired rows by a best-first search over (cost, audit), with the forms as a pattern."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.rstrip(" \t\n\v\f\r")
        faults.append("blank" if not body.strip(" \t\n\v\f\r") else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, at, letters, out = heapq.heappop(queue)
        if at == len(rows) and FORM.match(letters):
            counts = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost)
            return counts, audit, "\n".join(f"{role}:{text}" for role, text in out)
        key = (at, letters[:1] == "s", letters[-1:])
        if (key, "") in done:
            continue
        done.add((key, ""))
        options = [("user", "u"), ("assistant", "a")]
        fits = lambda more: re.match(r"(s?(ua)*u?)?\Z", letters + more)
        for role, c in options:
            if fits(c):
                heapq.heappush(queue, (cost + 2, audit + "I", at, letters + c, (*out, (role, ""))))
        if at < len(rows):
            _, role, text = rows[at]
            heapq.heappush(queue, (cost + 3, audit + "D", at + 1, letters, out))
            if faults[at] not in ("blank", "duplicate"):
                more = cost + (faults[at] == "truncated")
                if role[:1] in ("s", "u", "a") and fits(role[:1]):
                    heapq.heappush(queue, (more, audit + "K", at + 1, letters + role[:1], (*out, (role, text))))
                for other, c in options:
                    if fits(c):
                        heapq.heappush(queue, (more + 2, audit + "R", at + 1, letters + c, (*out, (other, text))))
    raise AssertionError


ROWS = st.lists(st.tuples(st.one_of(st.none(), st.integers(-3, 9)), st.sampled_from(["user", "assistant", "system", "tool", "", " "]), st.sampled_from(["", " \n", "a.", "b!", "cut", "d? \t", "e.\x00"])), max_size=9)


def codes_of(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, codes = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\v\f\r")
        fault = repair.BLANK if not body else repair.DUPLICATE if (role, text) in seen else repair.CUT if body[-1] not in ".!?" else repair.SOUND
        seen.add((role, text))
        codes.append(4 * fault + ("sua".find(role[:1]) if role[:1] in ("s", "u", "a") else repair.OTHER))
    return bytes(codes)


@given(ROWS)
@settings(max_examples=400, deadline=None)
def test_repair_is_the_cheapest_and_least(rows):
    counts, audit, _ = plain_repair(rows)
    for block in (1, 2, 3, 4_096):
        assert repair.solve(codes_of(rows), block) == (counts[-1], audit)


def test_repair_of_long_conversations_in_blocks():
    draw = random.Random(3)
    codes = bytes(draw.choice([0, 1, 2, 3, 4 + 1, 8 + 2, 12 + 1, 12 + 2]) for _ in range(20_000))
    whole = repair.solve(codes, 1 << 20)
    assert whole == repair.solve(codes) == repair.solve(codes, 7)


def repaired_rows(spark, tables):
    rows = [(conv, *r) for conv, table in tables.items() for r in table]
    return spark.createDataFrame(rows, CONVERSATION)


def test_repair_tables(spark):
    draw = random.Random(8)
    pick = lambda: (draw.choice([None, *range(8)]), draw.choice(["user", "assistant", "system", "tool", ""]), draw.choice(["", "a.", "b!", "cut", "d?\n"]))
    tables = {c: [pick() for _ in range(draw.randrange(1, 12))] for c in range(150)} | {None: [pick() for _ in range(5)]}
    tables[999] = [(i, "user", f"say {i % 700}.") for i in range(3_000)]
    docs = repaired_rows(spark, tables)
    got = {r["conv_id"]: r for r in repair.digests(docs).collect()}
    assert set(got) == set(tables)
    turns = {}
    for r in repair.repair(docs).collect():
        turns.setdefault(r["conv_id"], []).append(r)
    for conv, table in tables.items():
        r = got[conv]
        out = sorted(turns.get(conv, []), key=lambda t: t["position"])
        assert r["repaired_sha256"] == sha("\n".join(f"{t['role']}:{t['text']}" for t in out))
        assert FORM.match("".join(t["role"][:1] for t in out))
        assert "".join(t["edit"] for t in out) == r["audit"].replace("D", "")
        if conv == 999:
            assert r["duplicate"] == 2_300 and r["cost"] == 3 * 2_300 + 2 * 350
            continue
        counts, audit, whole = plain_repair(table)
        assert (tuple(r[c] for c in repair.COUNTS), r["audit"], r["repaired_sha256"]) == (counts, audit, sha(whole))


def test_repair_of_odd_tables(spark):
    odd = spark.createDataFrame([(None, None, None, None, "x"), (1, None, None, "hi.", "y"), (1, 2, "user", None, None)], f"{CONVERSATION}, counts string")
    got = {r["conv_id"]: r for r in repair.digests(odd).collect()}
    assert got[None]["blank"] == 1 and got[None]["audit"] == "D" and got[1]["blank"] == 1
    assert repair.digests(odd.limit(0)).count() == 0 and repair.repair(odd.limit(0)).count() == 0
    alone = repair.digests(odd.limit(0), spark.createDataFrame([(4,), (4,), (None,)], "conv_id long")).collect()
    assert sorted((r["conv_id"] or 0, r["cost"], r["audit"], r["repaired_sha256"]) for r in alone) == [(0, 0, "", sha("")), (4, 0, "", sha(""))]


def damaged(conv, turn, role, text):
    role, text = (" " if x is None else x for x in (role, text))
    kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
    if kind == 0:
        return []
    text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
    return [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def test_repair_query(spark, sf):
    tables = {}
    for r in queries.table(spark, sf, "conversations").collect():
        tables.setdefault(r["conv_id"], []).extend(damaged(*r))
    got = {r["conv_id"]: r for r in queries.op13_conversation_repair(spark, sf).collect()}
    assert set(got) == set(tables)
    for conv, table in tables.items():
        counts, audit, whole = plain_repair(table)
        r = got[conv]
        assert (tuple(r[c] for c in repair.COUNTS), r["audit"], r["repaired_sha256"]) == (counts, audit, sha(whole)), conv
