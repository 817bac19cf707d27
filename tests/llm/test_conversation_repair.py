"""Repair of conversations against a plain version that tries all edits."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

SCHEMA = "conv_id long, turn long, role string, text string, conv string, copies long, edit string"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def plain(rows):
    """rows of one conversation in order: (turn, role, text). The columns of the query but the id."""
    seen, faults = set(), []
    for _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        faults.append("blank" if not re.search(r"[^\x20\x09-\x0D]", text) else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))

    def then(state, role):
        return {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}[state].get(role[:1])

    @lru_cache(None)
    def best(at, state, added):
        found = []
        if at == len(rows):
            if state in ("", "a"):
                found.append((0, "", ()))
        else:
            _, role, text = rows[at]
            left = best(at + 1, state, 0)
            found.append((2 + left[0], "D" + left[1], left[2]))
            if faults[at] not in ("blank", "duplicate"):
                for letter, new in (("K", role), ("R", "user"), ("R", "assistant")):
                    if (q := then(state, new)) and (letter == "K" or new[0] in "ua"):
                        left = best(at + 1, q, 0)
                        found.append(((letter == "R") + 5 * (faults[at] == "truncated") + left[0], letter + left[1], (f"{new}:{text}", *left[2])))
        if added < 3:
            for new in ("user", "assistant"):
                if q := then(state, new):
                    left = best(at, q, added + 1)
                    found.append((5 + left[0], "I" + left[1], (f"{new}:", *left[2])))
        return min(found, default=(10**9, "", ()))

    cost, audit, lines = best(0, "", 0)
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def wanted(rows):
    left = damaged(rows)
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in left if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        out.append((conv, *plain(tuple(own))))
    return out


def conversations():
    r = random.Random(3)
    texts = ["Yes.", "no", "What?", "", " \t", None, "Go on! ", "then\n", "été.", "Ω"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "unknown", None, ""]
    rows = []
    for conv in range(300):
        for turn in range(r.randint(1, 9)):
            given = r.choice(roles[:4]) if r.random() < 0.7 else r.choice(roles)
            rows += [(conv, r.choice([turn, turn, turn, 2 * turn, None]), given, r.choice(texts))] * r.choice([1, 1, 1, 1, 3])
    rows += [(None, t, "user" if t % 2 == 0 else "assistant", f"text {t}.") for t in range(30)]
    rows += [(1000, t, r.choice(["user", "assistant", "tool"]), r.choice(["a.", "b.", "c", f"{t}.", f"{t}"])) for t in range(150)]
    rows += [(1001, 5, r.choice(["user", "assistant"]), f"{t}.") for t in range(60)]
    return rows


def ordered(rows):
    return sorted(rows, key=lambda x: (x[0] is None, str(x)))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 7, "y") for r in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("block", [1, 3, 16, 1024])
def test_repair(spark, block):
    from folioq.llm.conversation_repair import damaged as damage
    from folioq.llm.conversation_repair import digests, edits, repaired

    rows = conversations()
    out = digests(edits(damage(frame(spark, rows)), block)).collect()
    expected = {w[0]: w for w in wanted(rows)}
    empty = hashlib.sha256(b"").hexdigest()
    assert len(out) == sum(any(d[0] == c for d in damaged(rows)) for c in expected)
    for got in out:
        assert tuple(got) == expected.pop(got["conv"])
    assert all(w[1:] == (0, 0, 0, 0, 0, 0, "", empty) for w in expected.values())
    if block == 3:
        lines = repaired(damage(frame(spark, rows)), block).orderBy("pos", "nth").collect()
        text = "\n".join(f"{x['role']}:{x['text']}" for x in lines if x["conv"] == 1000)
        assert hashlib.sha256(text.encode()).hexdigest() == next(w for w in wanted(rows) if w[0] == 1000)[-1]


def test_query(spark, tmp_path):
    from folioq.llm.conversation_repair import op11_conversation_repair

    rows = conversations()
    frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    out = op11_conversation_repair(spark, str(tmp_path))
    assert ordered(map(tuple, out.collect())) == ordered(wanted(rows))
    frame(spark, rows).limit(0).write.parquet(f"{tmp_path}/empty/conversations.parquet")
    assert op11_conversation_repair(spark, f"{tmp_path}/empty").count() == 0


def test_audits_compare_as_texts():
    from folioq.llm import conversation_repair as repair

    r = random.Random(1)
    for modulus in (repair._MOD, 7):  # the small one makes hashes collide
        before, repair._MOD = repair._MOD, modulus
        try:
            audits = repair.Audits()
            nodes = [0]
            for _ in range(400):
                nodes.append(audits.grown(r.choice(nodes[-9:]), r.choice(["K", "K", "D", "IK", "R"])))
            for _ in range(3000):
                x, y = r.choice(nodes), r.choice(nodes)
                assert audits.less(x, y) == (audits.text(x) < audits.text(y))
        finally:
            repair._MOD = before
