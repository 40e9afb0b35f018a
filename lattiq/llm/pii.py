"""Personal data: seed detectors plus bootstrapped contextual extraction.

One pass over the texts finds *seeds* and *candidates*. Seeds are what the base detectors
match, and values of assignments that look drawn at random (seeds of the kind *secret*, which
is no base kind). Candidates have the look of an identifier but fail the detectors (a phone
number without a plus sign, an address without a domain, a card number with a wrong digit,
a short password). Both carry lexical patterns: the words around them, the beginning of
their line, and the name of the field that they are the value of. Spark then works on the
graph of distinct (pattern, instance) edges. A round scores each pattern for each kind as
s / (s + c + 1), with s instances believed to be of the kind and c that speak against it,
as their look rules the kind out or they are believed to be of another one; candidates of
which nothing is known yet count neither way. Patterns with enough support score instances
by noisy-or; after ``rounds`` rounds instances above ``min_score`` whose look allows the kind
are found. Copies collapse into the same edges, so one hot passage adds nothing.

Defined results: null text counts as empty; added spans never overlap base spans and
never replace them; a secret is added only where a pattern says so, never for its look;
an instance believed to be of two kinds takes the higher score, then the kind listed
first; repeated rows get the same spans; an empty table gives an empty result;
positions count code points, ends are exclusive.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from lattiq.llm.arrow import every, map_batches, map_in_place, unused
from lattiq.session import materialize

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")

# Fixed by the contract. A look-behind or a possessive quantifier only spares starts
# that cannot differ from the leftmost match.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_NUMBERS = re.compile(r"(?<![0-9A-Za-z])[0-9][0-9()./\x20-]{5,}[0-9](?![0-9A-Za-z])")
_FIELD = r"([A-Za-z][A-Za-z_-]{1,29})\x20?[:=]\x20?[\"']?"
_ASSIGNED = re.compile(_FIELD + r"([^\s\"'<>,;/][^\s\"'<>,;]{5,199})")
_FIELD_BEFORE = re.compile(_FIELD + "$")
_RANDOM = re.compile(r"[A-Za-z0-9+/=_-]{16,}")
_LETTER = re.compile(r"[A-Za-z]")
_GROUPS = re.compile(r"(?<![0-9A-Za-z.:])[0-9A-Fa-f]{1,4}+(?:[.:][0-9A-Fa-f]{1,4}+){3,}+(?![0-9A-Za-z])")
_DIGIT = re.compile(r"[0-9]")
_EDGE = ".,;:!?\"'()[]{}<>*#&%$=|"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Matches around each at sign; its local part is the run of local characters to its left."""
    out, at = [], 0
    for m in _DOMAIN.finditer(text):
        left = text[at : m.start()]
        start = at + len(left.rstrip(_LOCAL))
        if start < m.start():
            out.append((start, m.end()))
            at = m.end()
        else:
            at = m.start()
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    out: list[tuple[str, int, int]] = []
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() <= 37:  # 19 digits and 18 separators
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Spans that look like identifiers and touch no base span."""
    found = set()
    at = text.find("@")
    while at >= 0:
        a = at
        while a > 0 and not text[a - 1].isspace():
            a -= 1
        b = at
        while b < len(text) and not text[b].isspace():
            b += 1
        word = text[a:b]
        a, b = a + len(word) - len(word.lstrip(_EDGE)), b - len(word) + len(word.rstrip(_EDGE))
        if a < at < b - 1:
            found.add((a, b))
        at = text.find("@", max(b, at + 1))
    if _DIGIT.search(text):
        found |= {m.span() for m in _NUMBERS.finditer(text)} | {m.span() for m in _GROUPS.finditer(text)}
        if "=" in text or ":" in text:
            found |= {(m.start(2), m.start(2) + len(m[2].rstrip(_EDGE))) for m in _ASSIGNED.finditer(text) if _DIGIT.search(m[2])}
    edges = sorted((s, e) for _, s, e in taken)
    free, reached, k, far = [], -1, 0, -1
    for a, b in sorted(found, key=lambda x: (x[0], -x[1])):
        while k < len(edges) and edges[k][0] < b:  # `far`: how far the base spans that begin before b reach
            far = max(far, edges[k][1])
            k += 1
        if a >= reached and far <= a < b:
            free.append((a, b))
            reached = b
    return free


def shapes(value: str) -> list[str]:
    """Kinds that the look of a value allows."""
    digits = len(_DIGIT.findall(value))
    ok = []
    if "@" in value:
        return ["email"]
    if value.count(".") == 3 or value.count(":") >= 3:
        ok.append("ip")
    if 12 <= digits <= 19:
        ok.append("card")
    if 7 <= digits <= 15:
        ok.append("phone")
    if digits and _LETTER.search(value) and len(value) >= 6:
        return ["ip", "secret"] if "ip" in ok else ["secret"]  # letters rule out cards and phones
    return ok


def looks_random(value: str) -> bool:
    """Long, of letters and digits in numbers: the look of a key or a token."""
    return bool(_RANDOM.fullmatch(value)) and len(_DIGIT.findall(value)) >= 4 and len(_LETTER.findall(value)) >= 4


def patterns(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns of a mention: its field's name, two words before it, one on each side, and what its line begins with."""
    left, right = text[max(0, start - 80) : start].lower(), text[end : end + 40].lower()
    before, after = left.split()[-2:], right.split()[:1]
    out = []
    if field := _FIELD_BEFORE.search(left):
        out.append("field " + field[1])
    if len(before) == 2:
        out.append("before " + " ".join(before))
    if before and after:
        out.append(f"around {before[-1]} {after[0]}")
    head, newline, line = left.rpartition("\n")
    if (newline or start <= 80) and line.strip():
        out.append("line " + line.strip())
    return out


_MENTION = "struct<kind:string,seed:string,s:int,e:int,inst:string,pats:array<string>,kinds:array<string>>"


def mentions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, key (hash of id and text), and all seeds and candidates with their patterns."""

    def apply(rows: dict) -> dict:
        out = []
        for text in rows["text"]:
            text = text or ""
            base = base_spans(text)
            spans = [(k, a, b) for k, a, b in base] + [(None, a, b) for a, b in candidates(text, base)]
            out.append(
                [
                    {"kind": k, "seed": k or ("secret" if looks_random(v) else None), "s": a, "e": b, "inst": v.lower(), "pats": patterns(text, a, b), "kinds": [k] if k else shapes(v)}
                    for k, a, b in spans
                    if (v := text[a:b])
                ]
            )
        return {"doc_id": rows["doc_id"], "key": rows["key"], "found": out}

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), row_key(F.col(id_col), F.col(text_col)).alias("key"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return map_batches(narrow, apply, f"doc_id {kind}, key long, found array<{_MENTION}>")


def row_key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, text)


def bootstrap(found: DataFrame, rounds: int = 3, min_support: int = 3, min_pattern: float = 0.7, min_score: float = 0.8) -> DataFrame:
    """(inst, kind) of identifiers that the base detectors do not see.

    *min_support*: distinct believed instances a pattern needs; *min_pattern*: the score a
    pattern needs; *min_score*: the score an instance needs.
    """
    one = found.select(F.explode("found").alias("m")).select("m.*")
    edges = materialize(one.select(F.explode("pats").alias("pat"), "inst", "kind", "seed", "kinds").distinct(), "pattern-graph")
    width = edges.groupBy("pat").agg(F.count_distinct("inst").alias("width"))
    open_edges = edges.where("kind IS NULL").select("pat", "inst", F.explode("kinds").alias("kind")).distinct()
    seeds = edges.where("seed IS NOT NULL").select("pat", "inst", F.col("seed").alias("kind")).distinct()
    believed, scored = seeds, None
    for _ in range(rounds):
        unknown = open_edges.join(believed.select("inst").distinct(), "inst", "left_anti").groupBy("pat", "kind").agg(F.count_distinct("inst").alias("unknown"))
        score = F.col("support") / (F.col("width") - F.coalesce("unknown", F.lit(0)) + 1)
        pats = (
            believed.groupBy("pat", "kind")
            .agg(F.count_distinct("inst").alias("support"))
            .where(F.col("support") >= min_support)
            .join(width, "pat")
            .join(unknown, ["pat", "kind"], "left")
            .select("pat", "kind", score.alias("p"))
            .where(F.col("p") >= min_pattern)
        )
        scored = materialize(
            open_edges.join(pats, ["pat", "kind"])
            .groupBy("inst", "kind")
            .agg((1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-6), 1 - F.col("p")))))).alias("score"))
            .where(F.col("score") >= min_score),
            "instance-scores",
        )
        believed = seeds.unionByName(open_edges.join(scored.select("inst", "kind"), ["inst", "kind"], "left_semi")).distinct()
    order = F.array_position(F.array(*map(F.lit, ALL_KINDS)), F.col("kind"))
    return scored.groupBy("inst").agg(F.max_by("kind", F.struct("score", (-order).alias("o"))).alias("kind"))


def _added(found: DataFrame, learned: DataFrame) -> DataFrame:
    """Per row: a struct that names it, and the added spans."""
    free = found.select(_row("doc_id", "key").alias("row"), F.explode("found").alias("m")).where("m.kind IS NULL").select("row", "m.s", "m.e", "m.inst", F.col("m.seed").isNotNull().alias("seeded"))
    return free.join(learned, "inst").groupBy("row").agg(F.collect_set(F.struct("kind", "s", "e", "seeded")).alias("added"))


def _row(doc_id: Column | str, key: Column | str) -> Column:
    """Names a row by its id and its hash; equal structs agree in null ids too."""
    as_col = [F.col(c) if isinstance(c, str) else c for c in (doc_id, key)]
    return F.struct(as_col[0].alias("doc_id"), as_col[1].alias("key"))


def _joined(spans: Column) -> Column:
    """kind:start:end of all spans, by kind as listed, then start, joined by commas."""
    order = F.array(*map(F.lit, ALL_KINDS))
    ranked = F.array_sort(F.transform(spans, lambda x: F.struct(F.array_position(order, x["kind"]).alias("o"), x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
    return F.array_join(F.transform(ranked, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: doc_id, key, base (array of kind, s, e) and added (with *seeded*: whether its look had made it a seed)."""
    found = materialize(mentions(docs, id_col, text_col), "mentions")
    added = _added(found, bootstrap(found, **options))
    seeds = F.transform(F.filter("found", lambda m: m["kind"].isNotNull()), lambda m: F.struct(m["kind"].alias("kind"), m["s"].alias("s"), m["e"].alias("e")))
    none = F.array().cast("array<struct<kind:string,s:int,e:int,seeded:boolean>>")
    return found.join(added, _row("doc_id", found["key"]) == F.col("row"), "left").select("doc_id", "key", seeds.alias("base"), F.coalesce("added", none).alias("added"))


def report(docs: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, counts of the base kinds, base_sha256, spans, n_added, and of those n_secret and n_discovered (no seeds)."""
    got = find(docs, **options)
    named = F.transform("base", lambda m: m["kind"])
    counts = [(F.size(named) - F.size(F.array_remove(named, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return got.select(
        "doc_id",
        *counts,
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", F.transform("added", lambda m: F.struct(m["kind"].alias("kind"), m["s"].alias("s"), m["e"].alias("e"))))).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
        F.size(F.filter("added", lambda m: m["kind"] == "secret")).cast("long").alias("n_secret"),
        F.size(F.filter("added", lambda m: ~m["seeded"])).cast("long").alias("n_discovered"),
    )


def mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """*docs* with every span replaced by its kind in angle brackets; no row goes."""
    found = materialize(mentions(docs, id_col, text_col), "mentions")
    added = _added(found, bootstrap(found, **options))
    name = unused(docs, "row")
    named = added.select(F.struct("row", "added").alias(name))
    own = _row(F.col(id_col), row_key(F.col(id_col), F.col(text_col)))
    both = docs.join(named, own == F.col(name)["row"], "left").select(*every(docs), F.col(name)["added"].alias(name))
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = []
            for text, more in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if text:
                    text = masked(text, base_spans(text) + [(m["kind"], m["s"], m["e"]) for m in more or []])
                texts.append(text)
            cols = [pa.array(texts, batch.schema.field(i).type) if i == at else batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names[:-1])

    return map_in_place(both, run, dropped=1)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with spans replaced; of overlapping spans the parts join under the first kind."""
    out, at = [], 0
    for s, e, kind in sorted((s, e, ALL_KINDS.index(k)) for k, s, e in spans):
        if s >= at:
            out += [text[at:s], f"<{ALL_KINDS[kind].upper()}>"]
        at = max(at, e)
    return "".join(out) + text[at:]
