import random
import re

from lattiq.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    """The contract, word for word."""
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c.isdigit()]
            luhn = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_base_spans_equal_the_patterns():
    rng = random.Random(5)
    parts = ["a@b.c", "@", ".", "-", "+1", " ", "255", "256", "0001", "x", "4", "4111 1111 1111 1111", "4111-1111", "(", ")", "+49 (30) 1234567", "é", "10.0.0.1", "..", "a@b.c@d.e", "\n"]
    for _ in range(30000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert pii.base_spans(text) == plain(text), text


def test_base_spans_stay_linear_on_long_runs():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1(" * 100_000, "@a" * 100_000, "1 " * 200_000, "a@" * 100_000):
        pii.base_spans(text)
        pii.candidates(text, [])


def test_bootstrap_finds_unseen_identifiers(spark):
    rows = [(i, f"please call me at +1 (555) 200-{1000 + i} today") for i in range(8)]
    rows += [(100, "please call me at 555-200-9999 today"), (101, "order number 1234567 is here"), (102, None), (103, ""), (103, "")]
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].n_phone == 1 and got[0].n_added == 0
    assert got[100].n_phone == 0 and got[100].spans == "phone:18:30"
    assert got[101].spans == "" and got[102].spans == "" and got[103].n_added == 0


def test_secrets_need_a_pattern(spark):
    rng = random.Random(3)
    rows = [(i, f"w{i} v{i} password={''.join(rng.choice('abcdef0123456789') for _ in range(18))} u{i}") for i in range(6)]
    rows += [(50, "now password=hunter2x then"), (51, "a b 0123456789abcdef0123 c"), (52, "note: hello7 world"), (53, "see name: Johnny5x end")]
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].spans == f"secret:{15}:{33}" and got[i].n_secret == 1 for i in range(6))
    assert got[50].spans == "secret:13:21"  # its look alone says nothing, the field's name does
    assert all(got[i].spans == "" for i in (51, 52, 53))  # the look alone says nothing, nor does a field without seeds


def plain_bootstrap(mentions, rounds=3, min_support=3, min_pattern=0.7, min_score=0.8):
    """Scores by the definition, over (kind, seed, inst, patterns, kinds)."""
    pats = {p for m in mentions for p in m[3]}
    of = {p: {m[2] for m in mentions if p in m[3]} for p in pats}
    seeds = {(m[2], m[1]) for m in mentions if m[1]}
    open_ = {(p, m[2], k) for m in mentions if not m[0] for p in m[3] for k in m[4]}
    believed, scored = set(seeds), {}
    for _ in range(rounds):
        known = {i for i, _ in believed}
        kept = {}
        for p in pats:
            for k in pii.ALL_KINDS:
                support = len({i for i in of[p] if (i, k) in believed and (any(q == p and i == j and k == l for q, j, l in open_) or any(m[2] == i and m[1] == k and p in m[3] for m in mentions))})
                unknown = len({i for q, i, l in open_ if q == p and l == k and i not in known})
                if support >= min_support and support / (len(of[p]) - unknown + 1) >= min_pattern:
                    kept[p, k] = support / (len(of[p]) - unknown + 1)
        scored = {}
        for p, i, k in open_:
            if (p, k) in kept:
                scored[i, k] = scored.get((i, k), 1.0) * (1 - kept[p, k])
        scored = {x: 1 - v for x, v in scored.items() if 1 - v >= min_score}
        believed = seeds | set(scored)
    best = {}
    for (i, k), v in sorted(scored.items(), key=lambda x: (-x[1], pii.ALL_KINDS.index(x[0][1]))):
        best.setdefault(i, k)
    return best


def test_bootstrap_equals_its_definition(spark):
    rng = random.Random(11)
    kinds = [  # each kind has contexts of its own, in which seeds and other looks stand
        (["call me at", "tel"], ["+1 (555) 200-%04d", "+1 (555) 200-%04d", "555-200-%04d"]),
        (["write to us", "mail"], ["user%d@mail.org", "user%d@mail.org", "user%d@host"]),
        (["my key is", ""], ["password=ab12cd34ef56%06d", "password=x%05d", "id: 12345%03d"]),
        (["server at", "host"], ["10.0.0.%d", "10.0.1.%d", "fe80:1:2:%d"]),
    ]
    rows = []
    for i in range(240):
        heads, values = rng.choice(kinds)
        v = rng.choice(values) % rng.randint(1, 200)
        rows.append((i, f"{rng.choice(heads)} {v} {rng.choice(['today', 'now', ''])}"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.mentions(df)
    got = {r.inst: r.kind for r in pii.bootstrap(found).collect()}
    ms = [(m.kind, m.seed, m.inst, set(m.pats), list(m.kinds)) for r in found.collect() for m in r.found]
    assert got == plain_bootstrap(ms) and len(set(got.values())) > 1


#: Per kind: a context with seeds, one that only a belief of the first round can teach, a seed, and another look.
PLANTED = {
    "email": ("please write to {} about it", "forward copies over {} promptly", "person%d@mail.org", "person%d@intranet"),
    "ip": ("connect with host {} via ssh", "reboot node number {} overnight", "10.20.30.%d", "fe80:12:7:%d"),
    "card": ("charge my visa {} once more", "refund old plastic {} quietly", None, "4000 1234 5678 9%03d"),
    "phone": ("ring me at {} tonight dear", "dial desk line {} quickly then", "+1 (555) 200-%04d", "555-300-%04d"),
}


def card(n):
    digits = f"411111111111{n:03d}"
    return digits + next(str(c) for c in range(10) if pii.luhn(digits + str(c)))


def planted_documents():
    """(rows, expected): seeds, unseen values in both contexts, unseen ones in the second context only, and decoys elsewhere."""
    rng = random.Random(6)
    rows, want, late = [], {}, set()

    def add(text, value, kind=None, second=False):
        rows.append((len(rows), text.format(value)))
        if kind:
            want[len(rows) - 1] = f"{kind}:{text.index('{}')}:{text.index('{}') + len(value)}"
            if second:
                late.add(len(rows) - 1)

    for kind, (first, second, seed, other) in PLANTED.items():
        for n in range(20):
            add(first, seed % (n + 1) if seed else card(n))
        unseen = [v for n in range(100, 1000) if (v := other % n) and not pii.base_spans(v)]
        for v in unseen[:8]:
            add(first, v, kind)
            add(second, v, kind)
        for v in unseen[8:16]:
            add(second, v, kind, True)
        for v in unseen[16:28]:
            letters = ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(6)]
            add(f"{letters[0]} {letters[1]} {letters[2]} {{}} {letters[3]} {letters[4]} {letters[5]}", v)
    return rows, want, late


def test_unseen_identifiers_of_each_kind_are_found_over_two_rounds(spark):
    rows, want, late = planted_documents()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = pii.report(df).collect()
    assert {r.doc_id: r.spans for r in got if r.n_added} == want  # recall and precision of 1: decoys are left alone
    assert sum(r.n_discovered for r in got) == sum(r.n_added for r in got) == len(want) == 4 * 24
    for r in got:  # base columns are those of the base patterns alone
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for k, *_ in plain(rows[r.doc_id][1])) for kind in BASE)
    once = {r.doc_id for r in pii.report(df, rounds=1).collect() if r.n_added}
    assert late and not late & once  # the second context is learned from what the first round has found


def test_mask_changes_only_spans(spark):
    names = ("added", "_key", "_added", "row", "row_", "key", "found")
    cols = "".join(f", {n} string" for n in names)
    rows = [(1, "mail x@y.org now", *names), (2, None, *[None] * 7), (3, "clean", *names), (None, "mail x@y.org now", *names)]
    df = spark.createDataFrame(rows, "doc_id long, text string" + cols)
    got = {r.doc_id: r for r in pii.mask(df).collect()}
    assert got[1].text == got[None].text == "mail <EMAIL> now" and got[1].asDict().items() >= dict(zip(names, names)).items()
    assert got[2].text is None and got[3].text == "clean" and pii.mask(df).columns == df.columns


def test_empty_table(spark):
    assert pii.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
