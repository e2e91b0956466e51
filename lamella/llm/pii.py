"""Personal data by weak supervision, in DataFrame and SQL functions only.

Candidates are the matches of a pattern for each kind, with code-point offsets. Five labelers (validity of
the format, gazetteer, context words, token borders, variety of characters) vote yes, no or nothing on each. The
candidates are counted by pattern of kind, votes, length class and class of the share of digits, a table whose size the
classes bound; expectation-maximisation estimates from it how reliable each labeler is, and a logistic span classifier on
the votes, the kind, the length and the share of digits is trained on the resulting probabilities. Both are folds inside
one SQL expression over that small table. Valid matches of the four base kinds are always reported; the classifier adds
what else it takes for personal or secret. Texts are searched once: candidates are written to the shared folder, where
training and the result read them.

Positions come from pairs (gap, match) that tile the text: the gap is lazy and anchored at the last match's
end, so a text is read once, and a match never starts inside a run that an earlier start would have covered. The pairs are
summed in blocks, what stands before and after a match is carried along, and redaction takes its pieces from blocks of the text, so that
the work grows in proportion to the text and its matches.

Defined cases: null text is empty and has no spans; ids may be null or repeat, rows stay as they are; without
any candidate nothing is added; an empty table gives an empty result; other columns are not read (``redact``
keeps them all, whatever their names).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, unused

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
LABELERS = ("format", "gazetteer", "context", "borders", "variety")
SHAPE = ("length", "digits")  # other inputs of the classifier

#: For each kind: a cheap test that a text may have one, and the pattern. Repetitions are possessive where
#: nothing after them could use what they give back, and runs are only entered at their start.
_PATTERNS = {
    "email": ("@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9](?:[\x20-]?[0-9]){11}", r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
    "secret": (
        r"AKIA[0-9A-Z]{16}|(?i:password|passwd|secret|token|api_?key)",
        r"\bAKIA[0-9A-Z]{16}\b|(?i:\b(?:password|passwd|secret|token|api_?key)\s{0,3}[=:]\s{0,3}\x22?[A-Za-z0-9+/_.=~-]{8,}(?<!\.)\x22?)",
    ),
}
#: Country calling codes of one to three digits by first digits, common top-level domains, words
#: that announce a kind, and first digits of card issuers.
_CALLING = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21[1-8]|2[2-69][0-9]|35[0-9]|37[0-9]|38[0-9]|42[0-3]|50[0-9]|59[0-9]|67[0-9]|68[0-9]|69[0-2]|85[0-9]|88[06]|96[0-8]|97[0-9]|99[2-8])"
_DOMAINS = r"\.(?:com|org|net|edu|gov|info|biz|io|eu|de|fr|es|it|uk|us|nl|be|at|ch|pl|pt|se|no|dk|fi|ru|cn|jp|kr|in|br|mx|ar|au|ca|th)$"
_CUES = r"(?i)(?:e-?mail|contact|write|kontakt|correo|courriel|tel|phone|call|fax|mobil|ruf|llam|appel|card|visa|karte|carte|tarjeta|pay|ip|host|server|address|adresse|user|login|pass|key|token|secret)[^\s]{0,4}\s*$"
_ISSUERS = r"^(?:4|5[1-5]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720|3[47]|6011|64[4-9]|65|62|35)"

_DIGITS = "regexp_replace({m}, '[^0-9]', '')"


def _lit(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _valid(kind: str, m: str) -> str:
    """Whether a match is one of the base kind."""
    d = _DIGITS.format(m=m)
    if kind == "ip":
        return f"NOT exists(split({m}, '\\\\.'), p -> NOT p RLIKE '^0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$')"
    if kind == "card":
        doubled = "(CASE WHEN i % 2 = 1 THEN cast(substring(reverse({d}), i, 1) AS int) ELSE 2 * cast(substring(reverse({d}), i, 1) AS int) - IF(cast(substring(reverse({d}), i, 1) AS int) > 4, 9, 0) END)".format(d=d)
        return f"(length({d}) BETWEEN 14 AND 19 AND IF(length({d}) BETWEEN 14 AND 19, aggregate(sequence(1, length({d})), 0, (s, i) -> s + {doubled}) % 10 = 0, false))"
    if kind == "phone":
        return f"length({d}) BETWEEN 10 AND 15"
    return "true"


_BLOCK = 256  # pairs or spans that are folded together
_CHARS = 4096  # code points of a block of text


def _let(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with ``name`` standing for ``value``, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _blocks(array: str) -> str:
    return f"transform(sequence(0, greatest(size({array}) - 1, 0) div {_BLOCK}), j -> slice({array}, {_BLOCK} * j + 1, {_BLOCK}))"


def _tiled(pairs: str, kind: str, text: str) -> str:
    """SQL for structs (kind, s, e, m, before, after) from pairs (gap, hit); before has up to 20 characters, after one."""
    size, back = "length(p.gap) + length(p.hit)", "right(concat({}, p.gap, p.hit), 20)"
    starts = (
        "aggregate(c, array(struct(0 AS pos, '' AS back)), (z, b) -> array_append(z, struct("
        f"element_at(z, -1).pos + aggregate(b, 0, (n, p) -> n + {size}) AS pos, aggregate(b, element_at(z, -1).back, (y, p) -> {back.format('y')}) AS back)))"
    )
    found = "struct(z.pos + length(p.gap) AS s, z.pos + length(p.gap) + length(p.hit) AS e, p.hit AS m, right(concat(z.back, p.gap), 20) AS before)"
    each = (
        "aggregate(b, struct(st.pos AS pos, st.back AS back, cast(array() AS array<struct<s int, e int, m string, before string>>) AS found), "
        f"(z, p) -> struct(z.pos + {size} AS pos, {back.format('z.back')} AS back, array_append(z.found, {found}) AS found), z -> z.found)"
    )
    flat = _let(_blocks("t"), "c", f"flatten(zip_with(c, slice({starts}, 1, size(c)), (b, st) -> {each}))")
    follows = f"IF(i + 1 < size(t), left(IF(element_at(t, i + 2).gap <> '', element_at(t, i + 2).gap, element_at(t, i + 2).hit), 1), substring({text}, f.e + 1, 1))"
    return _let(pairs, "t", f"transform({flat}, (f, i) -> struct('{kind}' AS kind, f.s AS s, f.e AS e, f.m AS m, f.before AS before, {follows} AS after))")


def _votes(x: str) -> str:
    """The five votes on a candidate (1 yes, -1 no, 0 nothing), as an array."""
    m, kind = f"{x}.m", f"{x}.kind"
    digits = _DIGITS.format(m=m)
    gazetteer = (
        f"CASE {kind} WHEN 'email' THEN IF({m} RLIKE {_lit(_DOMAINS)}, 1, 0) "
        f"WHEN 'ip' THEN IF({m} RLIKE {_lit(r'^(?:0+|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])[.]')}, -1, 1) "
        f"WHEN 'card' THEN IF({digits} RLIKE {_lit(_ISSUERS)} AND length({digits}) BETWEEN 14 AND 19, 1, -1) "
        f"WHEN 'phone' THEN IF({m} RLIKE {_lit(_CALLING)}, 1, -1) ELSE IF({m} LIKE 'AKIA%' OR {m} RLIKE '[0-9]', 1, -1) END"
    )
    before = f"{x}.before"
    around = f"concat(IF({x}.s = 0, ' ', right({x}.before, 1)), IF({x}.after = '', ' ', {x}.after))"
    return (
        f"array(IF({x}.base, 1, -1), {gazetteer}, IF({before} RLIKE {_lit(_CUES)}, 1, 0), "
        f"IF({around} RLIKE {_lit(r'^[\s(<,;:x22x27|][\s)>,;:.!?x22x27|]$'.replace('x22', chr(92) + 'x22').replace('x27', chr(92) + 'x27'))}, 1, -1), "
        f"IF(size(array_distinct(split({m}, ''))) >= 5, 1, -1))"
    )


def _shape(x: str) -> str:
    """Length class (of 8, by doubling) and class of the share of digits (of 5) of a candidate, both from 0 to 1."""
    m = f"{x}.m"
    return f"array(least(floor(log2(length({m}))), 7) / 7D, floor(4 * length({_DIGITS.format(m=m)}) / length({m})) / 4D)"


def candidates(docs: DataFrame, text: str = "text", name: str = "spans") -> DataFrame:
    """Add a column ``name``: structs (kind, s, e, m, base, votes, shape) of every candidate in column ``text`` (not null)."""
    parts = []
    found_in = unused("found", [*docs.columns, name])
    for kind in KINDS:
        cheap, pattern = _PATTERNS[kind]
        tiled = _lit(rf"(?s)\G(.*?)({pattern})")
        may = f"contains({text}, '@')" if kind == "email" else f"{text} RLIKE {_lit(cheap)}"
        pairs = f"zip_with(regexp_extract_all({text}, {tiled}, 1), regexp_extract_all({text}, {tiled}, 2), (gap, hit) -> struct(gap, hit))"
        placed = _tiled(pairs, kind, text)
        base = _valid(kind, "c.m") if kind in BASE else "false"
        kept = f"filter({placed}, c -> length({_DIGITS.format(m='c.m')}) BETWEEN 12 AND 19)" if kind == "card" else placed
        fields = "c.kind AS kind, c.s AS s, c.e AS e, c.m AS m, c.before AS before, c.after AS after"
        parts.append(f"IF({may}, transform({kept}, c -> struct({fields}, {base} AS base)), cast(array() AS array<struct<kind string, s int, e int, m string, before string, after string, base boolean>>))")
    found = docs.withColumn(found_in, F.expr(f"concat({', '.join(parts)})"))
    voted = f"transform({found_in}, c -> struct(c.kind AS kind, c.s AS s, c.e AS e, c.m AS m, c.base AS base, {_votes('c')} AS votes, {_shape('c')} AS shape))"
    return found.withColumn(name, F.expr(voted)).drop(found_in)


@dataclass(frozen=True)
class Classifier:
    """Weights of votes, of kinds and of the shape in the span classifier; and what EM found about each labeler: how
    often its vote is yes on real and on false spans."""

    votes: tuple[float, ...] = (0.0,) * len(LABELERS)
    kinds: tuple[float, ...] = (-1.0,) * len(KINDS)
    shape: tuple[float, ...] = (0.0,) * len(SHAPE)
    yes_if_real: tuple[float, ...] = ()
    yes_if_false: tuple[float, ...] = ()

    def probability(self, x: str) -> str:
        """SQL for the probability that candidate ``x`` is real."""
        z = " + ".join(f"({w!r}D) * element_at({x}.votes, {j + 1})" for j, w in enumerate(self.votes))
        z += "".join(f" + ({w!r}D) * element_at({x}.shape, {j + 1})" for j, w in enumerate(self.shape))
        k = " ".join(f"WHEN '{kind}' THEN {w!r}D" for kind, w in zip(KINDS, self.kinds, strict=True))
        return f"(1 / (1 + exp(-({z} + CASE {x}.kind {k} END))))"


def patterns(found: DataFrame, name: str = "spans") -> DataFrame:
    """``kind, votes, shape, n``: candidates counted by pattern."""
    c = found.select(F.explode(name).alias("c"))
    return c.groupBy(*(F.col(f"c.{x}").alias(x) for x in ("kind", "votes", "shape"))).agg(F.count("*").cast("double").alias("n"))


def fit(found: DataFrame, name: str = "spans", rounds: int = 30, steps: int = 300, rate: float = 1.0) -> Classifier:
    """EM over the pattern counts, then the span classifier by gradient ascent on its probabilities."""
    m = len(LABELERS)
    table = patterns(found, name).agg(F.sort_array(F.collect_list(F.struct("kind", "votes", "shape", "n"))).alias("p"))
    j = f"sequence(1, {m})"
    logit = (
        f"ln(t.pi / (1 - t.pi)) + aggregate({j}, 0D, (z, j) -> z + CASE element_at(q.votes, j) WHEN 1 THEN ln(element_at(t.a, j) / element_at(t.b, j)) "
        f"WHEN -1 THEN ln((1 - element_at(t.a, j)) / (1 - element_at(t.b, j))) ELSE 0D END)"
    )
    posterior = f"transform(p, q -> struct(q.kind AS kind, q.votes AS votes, q.shape AS shape, q.n AS n, 1 / (1 + exp(-({logit}))) AS r))"

    def share(weight: str) -> str:
        yes = f"aggregate(w, 0D, (z, q) -> z + IF(element_at(q.votes, j) = 1, q.n * {weight}, 0D))"
        cast = f"aggregate(w, 0D, (z, q) -> z + IF(element_at(q.votes, j) <> 0, q.n * {weight}, 0D))"
        return f"transform({j}, j -> ({yes} + 1) / ({cast} + 2))"

    total = "aggregate(w, 0D, (z, q) -> z + q.n)"
    update = f"element_at(transform(array({posterior}), w -> struct((aggregate(w, 0D, (z, q) -> z + q.n * q.r) + 1) / ({total} + 2) AS pi, {share('q.r')} AS a, {share('(1 - q.r)')} AS b)), 1)"
    # a labeler is believed to be better than chance at the start, which decides what "real" means
    start = f"struct(0.8D AS pi, transform({j}, j -> 0.8D) AS a, transform({j}, j -> 0.3D) AS b)"
    em = table.withColumn("t", F.expr(f"aggregate(sequence(1, {rounds}), {start}, (t, i) -> {update})")).withColumn("w", F.expr(posterior))
    kinds = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    rows = f"transform(w, q -> struct(concat(transform(q.votes, v -> cast(v AS double)), transform({kinds}, k -> IF(k = q.kind, 1D, 0D)), q.shape) AS x, q.n AS n, q.r AS r))"
    size = m + len(KINDS) + len(SHAPE)
    margin = f"aggregate(sequence(1, {size}), 0D, (z, k) -> z + element_at(g, k) * element_at(q.x, k))"
    miss = f"transform(d, q -> struct(q.x AS x, q.n * (q.r - 1 / (1 + exp(-({margin})))) AS u))"
    climb = f"element_at(transform(array({miss}), e -> transform(sequence(1, {size}), k -> element_at(g, k) * 0.999D + {rate}D * aggregate(e, 0D, (z, q) -> z + q.u * element_at(q.x, k)) / s)), 1)"
    fitted = em.withColumn("d", F.expr(rows)).withColumn("s", F.expr("greatest(aggregate(w, 0D, (z, q) -> z + q.n), 1D)"))
    got = fitted.select(F.expr(f"aggregate(sequence(1, {steps}), transform(sequence(1, {size}), k -> 0D), (g, i) -> {climb})").alias("g"), "t", F.size("p").alias("n")).first()
    if got is None or not got["n"]:
        return Classifier()
    k = m + len(KINDS)
    return Classifier(tuple(got["g"][:m]), tuple(got["g"][m:k]), tuple(got["g"][k:]), tuple(got["t"]["a"]), tuple(got["t"]["b"]))


_ORDER = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"


def _sorted(spans: str) -> str:
    """By start, then kind as listed."""
    return f"array_sort(transform({spans}, c -> struct(c.s AS s, array_position({_ORDER}, c.kind) AS k, c.e AS e)))"


def _written(spans: str) -> str:
    return f"array_join(transform({_sorted(spans)}, c -> concat_ws(':', element_at({_ORDER}, cast(c.k AS int)), c.s, c.e)), ',')"


def detect(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_spans, spans``; spans as text, kind:start:end."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = stored(candidates(rows).select("doc_id", "spans"), "spans")
    model = fit(found)
    base = "filter(spans, c -> c.base)"
    counts = [F.expr(f"cast(size(filter(spans, c -> c.base AND c.kind = '{k}')) AS long)").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.expr(_written(base)).alias("base_spans"), F.expr(_written(f"filter(spans, c -> c.base OR {model.probability('c')} >= {threshold}D)")).alias("spans"))


def redact(docs: DataFrame, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` with every reported span replaced by its kind in angle brackets; overlapping spans become the
    first one's mark. All columns stay; a null text stays null."""
    text, spans = unused("text_in", docs.columns), unused("spans_in", docs.columns)
    found = stored(candidates(docs.withColumn(text, F.coalesce(F.col(text_col).cast("string"), F.lit(""))), text, spans).drop(text), "spans")
    model = fit(found, spans)
    chosen = _sorted(f"filter({spans}, c -> c.base OR {model.probability('c')} >= {threshold}D)")
    # each span with the end of all before it: one that begins earlier is covered by their mark
    starts = "aggregate(c, array(0), (z, b) -> array_append(z, greatest(element_at(z, -1), array_max(transform(b, x -> x.e)))))"
    each = (
        "aggregate(b, struct(st AS pos, cast(array() AS array<struct<pos int, s int, k bigint, e int>>) AS done), "
        "(z, x) -> struct(greatest(z.pos, x.e) AS pos, array_append(z.done, struct(z.pos AS pos, x.s AS s, x.k AS k, x.e AS e)) AS done), z -> z.done)"
    )
    marked = _let(chosen, "t", _let(_blocks("t"), "c", f"flatten(zip_with(c, slice({starts}, 1, size(c)), (b, st) -> {each}))"))
    block = lambda at: f"coalesce(get(w, {at} div {_CHARS}), '')"
    gap = (
        f"CASE WHEN x.s = x.pos THEN '' WHEN x.pos div {_CHARS} = (x.s - 1) div {_CHARS} THEN substring({block('x.pos')}, x.pos % {_CHARS} + 1, x.s - x.pos) "
        f"ELSE concat(substring({block('x.pos')}, x.pos % {_CHARS} + 1), array_join(slice(w, cast(x.pos div {_CHARS} + 2 AS int), cast((x.s - 1) div {_CHARS} - x.pos div {_CHARS} - 1 AS int)), ''), "
        f"substring({block('(x.s - 1)')}, 1, cast(x.s - (x.s - 1) div {_CHARS} * {_CHARS} AS int))) END"
    )
    marks = f"array_join(transform(filter(m, x -> x.s >= x.pos), x -> concat({gap}, '<', upper(element_at({_ORDER}, cast(x.k AS int))), '>')), '')"
    last = "array_max(transform(m, x -> x.e))"
    tail = _let(last, "e", f"concat(substring({block('e')}, e % {_CHARS} + 1), array_join(slice(w, cast(e div {_CHARS} + 2 AS int), size(w)), ''))")
    pieces = _lit(rf"(?s).{{1,{_CHARS}}}")
    folded = _let(marked, "m", f"IF(size(m) = 0, {text}, {_let(f'regexp_extract_all({text}, {pieces}, 0)', 'w', f'concat({marks}, {tail})')})")
    out = found.withColumn(text, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return out.withColumn(text_col, F.when(F.size(spans) > 0, F.expr(folded)).otherwise(F.col(text_col))).select(*docs.columns)
