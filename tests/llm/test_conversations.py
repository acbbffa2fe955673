import hashlib
import itertools
import random
import re
import time
import zlib

from emberlane.llm import conversations as c

LETTERS = {0: "x", 1: "s", 2: "u", 3: "a"}


def every_way(codes):
    """The least (cost, audit) by trying all edits, with up to two turns inserted at any place."""
    gaps = ["", "u", "a", "ua", "au"]
    best = None
    for inserted in itertools.product(gaps, repeat=len(codes) + 1):
        for edits in itertools.product(["D", "K", "Ru", "Ra"], repeat=len(codes)):
            cost, audit, roles = 0, "", ""
            for gap, edit, code in zip(inserted, edits, codes):
                cost, audit, roles = cost + 2 * len(gap), audit + "I" * len(gap) + edit[0], roles + gap
                if edit == "D":
                    cost += 3
                    continue
                if code >> 2 in (c.BLANK, c.DUPLICATE):
                    break
                cost += (code >> 2 == c.TRUNCATED) + (2 if edit[0] == "R" else 0)
                roles += edit[1] if edit[0] == "R" else LETTERS[code & 3]
            else:
                gap = inserted[-1]
                if re.fullmatch("(s?(ua)+)?", roles + gap):
                    found = (cost + 2 * len(gap), audit + "I" * len(gap))
                    best = found if best is None else min(best, found)
    return best


def table_of_strings(codes):
    """The same by a table that holds every state's best audit."""
    best = {c.START: (0, "")}
    for code in codes:
        new = {}
        for a, b, cost, letters in c.MOVES[code]:
            if a in best:
                new[b] = min(new.get(b, (c.FAR, "")), (best[a][0] + cost, best[a][1] + letters))
        best = new
    return min((cost + 2 * n, audit + "I" * n) for s, (cost, audit) in best.items() for n in [min(c._STEPS[s][e] for e in c.ENDS)])


def test_equal_to_trying_all_edits():
    for n in (0, 1, 2):
        for codes in itertools.product(range(16), repeat=n):
            assert c.repair(bytes(codes)) == every_way(codes), codes
    draw = random.Random(1)
    for _ in range(12):
        codes = [draw.randrange(16) for _ in range(3)]
        assert c.repair(bytes(codes)) == every_way(codes), codes


def test_equal_to_a_whole_table_and_long_conversations_take_little():
    draw = random.Random(2)
    for n in (4, 7, 8, 9, 33, 200):
        for _ in range(60):
            codes = bytes(draw.choice([1, 2, 3, 2, 3, draw.randrange(16)]) for _ in range(n))
            assert c.repair(codes) == table_of_strings(codes)
    started = time.time()
    cost, audit = c.repair(bytes([2, 2, 3, 7] * 10_000))
    assert len(audit.replace("I", "")) == 40_000 and cost > 0 and time.time() - started < 60


def by_hand(rows):
    """Damage and repair in plain Python."""
    spaced = lambda v: " " if v is None else str(v)
    result = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            kind = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20
            role, text = spaced(role), spaced(text)
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            role = "user" if kind == 4 else role
            kept += [] if kind == 0 else [(turn, role, text)] * (2 if kind == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(f"{r[1]}:{r[2]}".encode()).digest()))
        counts, codes, seen = [0] * 4, [], set()
        for _, role, text in kept:
            ends = re.sub(r"[\x20\x09-\x0D]", "", text)[-1:]
            fault = c.BLANK if not ends else c.DUPLICATE if (role, text) in seen else c.TRUNCATED if ends not in ".!?" else c.SOUND
            seen.add((role, text))
            counts[fault] += 1
            codes.append({"s": 1, "u": 2, "a": 3}.get(role[:1], 0) + 4 * fault)
        cost, audit = table_of_strings(codes) if codes else (0, "")
        written, left, roles = [], list(kept), ""
        for letter in audit:
            turn, role, text = (None, None, "") if letter == "I" else left.pop(0)
            if letter == "D":
                continue
            role = role if letter == "K" else "assistant" if roles[-1:] == "u" else "user"
            roles += role[0]
            written.append(f"{role}:{text}")
        turns = [r[0] for r in kept if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        result[conv] = (gaps, counts[1], counts[2], counts[3], illegal, cost, audit, hashlib.sha256("\n".join(written).encode()).hexdigest())
    return result


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def odd_rows():
    draw = random.Random(4)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", None, "", "sure", "Äh"]
    texts = ["Hello there.", "Well?", "no end", "", None, " \t\n", "Fine! \n", "é.", "\x85", "x" * 3000 + ".", "a\nb."]
    rows = [(draw.choice([None, *range(40)]), draw.choice([None, *range(-3, 12)]), draw.choice(roles), draw.choice(texts)) for _ in range(900)]
    # One conversation with a third of all rows, most of them equal.
    rows += [(77, draw.choice([1, 2, 3, None]), "user", "Again.") for _ in range(300)] + [(78, k, "user", "Again.") for k in range(150)]
    return rows


def test_odd_rows_equal_plain_python(spark):
    rows = odd_rows()
    table = spark.createDataFrame([(*r, 1, "x", b"y") for r in rows], SCHEMA + ", n int, audit string, mark binary")
    found = {r[0]: tuple(r)[1:] for r in c.repair_conversations(table.repartition(5)).collect()}
    assert found == by_hand(rows)


def test_conversations_that_damage_leaves_empty_and_an_empty_table(spark):
    dropped = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    found = c.repair_conversations(spark.createDataFrame([(dropped, 0, "user", "Hi.")], SCHEMA)).collect()
    assert [tuple(r) for r in found] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert c.repair_conversations(spark.createDataFrame([], SCHEMA)).count() == 0
