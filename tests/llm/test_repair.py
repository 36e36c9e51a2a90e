import hashlib
import heapq
import random
import re
import zlib

from inkspan.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, edit int, digest string"


def cheapest(rows):
    """Least (cost, audit) and its turns by a search over all edits in order of weight."""
    queue = [(0, "", 0, "")]
    done = set()
    texts = {(0, "", 0, ""): []}
    while True:
        now = heapq.heappop(queue)
        cost, audit, i, roles = now
        said = texts.pop(now)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, said
        state = (i, roles[-1:], "s" in roles)
        if state in done:
            continue
        done.add(state)
        steps = [(2, "I", i, x, (repair.ROLES[x], "")) for x in "ua"]
        if i < len(rows):
            role, text, fault = rows[i]
            steps.append((3, "D", i + 1, "", None))
            if fault not in ("blank", "duplicate"):
                late = fault == "truncated"
                steps += [(2 + late, "R", i + 1, x, (repair.ROLES[x], text)) for x in "ua"]
                if role[:1] in ("s", "u", "a"):
                    steps.append((late, "K", i + 1, role[0], (role, text)))
        for price, label, j, role, turn in steps:
            if re.fullmatch("s?(ua)*u?", roles + role):
                new = (cost + price, audit + label, j, roles + role)
                if new not in texts:
                    texts[new] = said + ([turn] if turn else [])
                    heapq.heappush(queue, new)


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        last = re.sub(r"[\x20\x09-\x0D]", "", text)[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def expected(conversation):
    """The contract's row for the rows (turn, role, text) of one conversation."""
    rows = []
    for key, turn, role, text in conversation:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if key is None else key}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            row = (turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            rows += [row] * (2 if kind == 3 else 1)
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    found = faults([r[1:] for r in rows])
    turns = {r[0] for r in rows} - {None}
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(found, found[1:], strict=False)]
    cost, audit, said = cheapest(found)
    count = lambda f: sum(x[2] == f for x in found)
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, count("blank"), count("duplicate"), count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest)


def conversations():
    rng = random.Random(11)
    rows = []
    for key in [*range(40), None]:
        n = rng.choice([1, 2, 3, 5, 8, 14])
        for turn in range(n):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "superuser"])
            text = rng.choice(["Yes.", "No!", "So", "a: b?\n ", " \t\n", "", None, "Yes.", f"t{turn}.", "ü é. x"])
            rows.append((key, rng.choice([turn, turn, turn * 2, None, 3]), role, text, 1, "x"))
    return rows


def test_equals_a_search_over_all_edits(spark, monkeypatch):
    rows = conversations()
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r[:4])
    for bits in (repair.BLOCK_BITS, 1):  # the latter cuts conversations after every second row
        monkeypatch.setattr(repair, "BLOCK_BITS", bits)
        got = {r.conv_id: tuple(r)[1:] for r in repair.op11(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
        assert got == {key: expected(own) for key, own in by.items()}


def test_blocks_multiply_to_the_whole():
    rng = random.Random(3)
    for _ in range(150):
        symbols = "".join(rng.choice("suaoSUAOx") for _ in range(rng.randint(0, 12)))
        whole = repair.shortest(symbols, repair.START)
        want = min(whole[s] for s in repair.FINAL if s in whole)
        cuts = sorted(rng.sample(range(len(symbols) + 1), min(len(symbols), 3)))
        parts = [symbols[a:z] for a, z in zip([0, *cuts], [*cuts, len(symbols)], strict=True)]
        assert repair.through_blocks([repair.block_weights(p) for p in parts]) == want
        rows = [({"s": "system", "u": "user", "a": "assistant"}.get(c.lower(), "other"), "", "blank" if c == "x" else "truncated" if c.isupper() else None) for c in symbols]
        assert cheapest(rows)[:2] == want


def test_long_repeated_and_empty(spark):
    long = "word " * 200_000 + "end."
    rows = [(7, t, ("user", "assistant")[t % 2], long + str(t) + ".", 1, "x") for t in range(3)]
    rows += [(8, 1, "user", "same.", 1, "x")] * 1500 + [(8, 2, "assistant", "ok.", 1, "x")]
    frame = spark.createDataFrame(rows, SCHEMA)
    plain = repair.plain(frame)
    found = {r.conv_id: r for r in repair.repairs(plain).collect()}
    assert found[8].duplicate == 1499 and found[8].audit == "K" + "D" * 1499 + "K" and found[8].cost == 3 * 1499
    assert found[7].audit == "KKKI" and found[7].cost == 2
    turns = repair.repaired(plain, repair.repairs(plain)).where("conv_id = 7").collect()
    assert [(t.role, t.edit) for t in turns] == [("user", "K"), ("assistant", "K"), ("user", "K"), ("assistant", "I")] and turns[0].text == long + "0."
    none = repair.op11(spark.createDataFrame([], SCHEMA))
    assert none.count() == 0 and "audit" in none.columns


def test_all_rows_dropped(spark):
    key = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    row = repair.op11(spark.createDataFrame([(key, 0, "user", "Hello.")], "conv_id long, turn long, role string, text string")).first()
    assert tuple(row) == (key, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
