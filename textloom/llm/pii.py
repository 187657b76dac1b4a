"""Personal data: patterns propose spans, checksums confirm them, context words score them.

DataFrame functions only. `split` and `regexp_extract_all` with one pattern give the text between
and in the matches; running sums of their lengths, taken in blocks of blocks, give every span's
place in code points in time that grows with the text, however many matches there are. The patterns
are the plain ones with possessive quantifiers, and a look-behind that skips starts which can only
fail (or `\\G`, right after the last match), so a long run of letters or digits costs linear time.

Kinds that a form or check digits confirm reach the threshold alone: email, ip, card (Luhn), phone,
iban and nir (mod 97), secrets with a known prefix. The others are proposals that count only if a
word nearby lifts their score: ssn, tel (a number without a country), dni (check letter, one in 23
by chance), secrets that are just hexadecimal. Context is looked for in the characters before and
behind a span, up to the next match of its kind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import spread

# Fixed patterns of the contract, made linear.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Kinds that the method adds.
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
NIR = r"(?<![0-9A-Za-z])[12]\x20?[0-9]{2}\x20?[0-9]{2}\x20?[0-9]{2}\x20?[0-9]{3}\x20?[0-9]{3}\x20?[0-9]{2}(?![0-9A-Za-z])"
DNI = r"(?<![0-9A-Za-z])[0-9]{8}-?[A-Z](?![0-9A-Za-z])"
TEL = r"(?<![0-9A-Za-z+.-])\(?0[0-9]{1,4}\)?(?:[\x20./-]?[0-9]){5,10}+(?![0-9A-Za-z])"
SECRET = r"(?<![A-Za-z0-9_-])(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,255}+|github_pat_[A-Za-z0-9_]{20,255}+|sk-[A-Za-z0-9_-]{20,255}+|[0-9a-fA-F]{32,128}+)(?![A-Za-z0-9_-])"
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "nir", "dni", "tel", "secret")
#: Words that raise a score when they stand near a span.
WORDS = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|courriel|correo)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|adresse)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|credit|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|telefon|fax)\b",
    "iban": r"(?i)\b(?:iban|account|konto|compte|cuenta)\b",
    "ssn": r"(?i)\b(?:ssn|social security)\b",
    "nir": r"(?i)\b(?:nir|insee|s[ée]curit[ée] sociale)\b",
    "dni": r"(?i)\b(?:dni|nif|documento|identidad)\b",
    "tel": r"(?i)\b(?:phone|tel|t[ée]l[ée]phone|telefon|tel[ée]fono|call|mobile|handy|m[óo]vil|fax|rufnummer)\b",
    "secret": r"(?i)\b(?:token|secret|password|passwd|pwd|api[_ -]?key|access[_ -]?key|private[_ -]?key|authorization|bearer|credentials?)\b",
}
#: Characters looked at before and behind a span.
CONTEXT, BEHIND = 48, 24
#: Score before context; a context word adds 0.4. Confirmed kinds start at the threshold.
BASE = {"email": 0.6, "ip": 0.5, "card": 0.6, "phone": 0.5, "iban": 0.6, "ssn": 0.2, "nir": 0.5, "dni": 0.3, "tel": 0.2, "secret": 0.6}
RAISED = 0.4
THRESHOLD = 0.5
#: Score of a secret that is only hexadecimal; without a word nearby it may be any checksum.
HEXADECIMAL = 0.3
#: Blocks of a running sum, and how often blocks are taken of blocks.
BLOCK, LEVELS = 64, 3


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _before(sizes: Column, levels: int = LEVELS) -> Column:
    """Sum of the elements before each element. An array grows by copying, so blocks are summed apart and joined."""
    zero = F.array().cast("array<bigint>")
    if not levels:
        step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(sizes, F.struct(F.lit(0).cast("bigint").alias("at"), zero.alias("out")), step, lambda acc: acc["out"])

    def of_blocks(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda a, x: a + x))
        step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.flatten(F.zip_with(blocks, _before(sums, levels - 1), lambda b, o: F.aggregate(b, F.struct(o.alias("at"), zero.alias("out")), step, lambda acc: acc["out"])))

    last = F.greatest(F.lit(0), F.floor((F.size(sizes) - 1) / F.lit(BLOCK)).cast("int"))
    return _let(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(sizes, i * BLOCK + 1, BLOCK)), of_blocks)


def _matches(text: Column, pattern: str, gate: Column) -> Column:
    """array<struct<start,end,body,left,right>> of the leftmost non-overlapping matches; gate: cheap test that skips a text."""
    kind = "array<struct<start:int,end:int,body:string,left:string,right:string>>"

    def placed(between: Column, bodies: Column) -> Column:
        # lengths of a piece of text and the match behind it; the sum before is where the piece starts
        sizes = F.transform(bodies, lambda m, i: (F.char_length(F.get(between, i)) + F.char_length(m)).cast("bigint"))
        pieces = F.transform(bodies, lambda m, i: F.struct(F.get(between, i).alias("b"), m.alias("m"), F.get(between, i + 1).alias("a")))
        return _let(sizes, lambda s: F.zip_with(pieces, _before(s), one)).cast(kind)

    def one(x: Column, at: Column) -> Column:
        start = at + F.char_length(x["b"])
        return F.struct(start.alias("start"), (start + F.char_length(x["m"])).alias("end"), x["m"].alias("body"), F.right(x["b"], F.lit(CONTEXT)).alias("left"), F.substring(x["a"], 1, BEHIND).alias("right"))

    found = _let(F.split(text, pattern, -1), lambda between: _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda bodies: F.when(F.size(bodies) > 0, placed(between, bodies))))
    return F.coalesce(F.when(gate, found), F.array().cast(kind))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Luhn's checksum of a string of digits is a multiple of 10."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda c: F.when(c == "", 0).otherwise(c.cast("int")))
    odd = F.transform(d, lambda v, i: F.when(i % 2 == 0, v).when(v > 4, 2 * v - 9).otherwise(2 * v))
    return F.aggregate(odd, F.lit(0), lambda a, v: a + v) % 10 == 0


def _mod97(iban: Column) -> Column:
    """ISO 7064 check: the number read with the first four characters moved to the end leaves 1."""
    s = F.regexp_replace(iban, " ", "")
    chars = F.split(F.concat(F.substring(s, 5, 64), F.substring(s, 1, 4)), "")
    code = lambda c: F.ascii(c)

    def step(acc: Column, c: Column) -> Column:
        return F.when(c == "", acc).when(code(c) < 58, (acc * 10 + code(c) - 48) % 97).otherwise((acc * 100 + code(c) - 55) % 97)

    return F.aggregate(chars, F.lit(0), step) == 1


def _ip_ok(s: Column) -> Column:
    bare = F.transform(F.split(s, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(bare, lambda p: (F.char_length(p) < 3) | ((F.char_length(p) == 3) & (p <= "255")))


#: Fixed check letters by remainder.
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"


def _valid(kind: str, body: Column) -> Column:
    n = F.char_length(_digits(body))
    if kind == "ip":
        return _ip_ok(body)
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(_digits(body))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    if kind == "nir":  # 97 less the first 13 digits' remainder is the last two
        d = _digits(body)
        return 97 - F.substring(d, 1, 13).cast("bigint") % 97 == F.substring(d, 14, 2).cast("bigint")
    if kind == "dni":
        return F.substring(F.lit(DNI_LETTERS), (F.substring(body, 1, 8).cast("int") % 23 + 1), F.lit(1)) == F.right(body, F.lit(1))
    if kind == "iban":
        return F.when(F.char_length(F.regexp_replace(body, " ", "")).between(15, 34), _mod97(body)).otherwise(False)
    return F.lit(True)


def _spans(text: Column, kind: str, pattern: str, gate: Column) -> Column:
    found = F.filter(_matches(text, pattern, gate), lambda x: _valid(kind, x["body"]))

    def scored(x: Column) -> Column:
        near = F.regexp_like(x["left"], F.lit(WORDS[kind])) | F.regexp_like(x["right"], F.lit(WORDS[kind]))
        base = F.when(F.regexp_like(x["body"], F.lit("^[0-9a-fA-F]+$")), HEXADECIMAL).otherwise(BASE[kind]) if kind == "secret" else F.lit(BASE[kind])
        score = F.round(base + F.when(near, RAISED).otherwise(0.0), 2)
        return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), score.alias("score"))

    return F.filter(F.transform(found, scored), lambda x: x["score"] >= THRESHOLD)


def _with_spans(docs: DataFrame, text_col: str) -> DataFrame:
    text = F.col("text")
    some = F.regexp_like(text, F.lit("[0-9]"))
    gates = {"email": (EMAIL, F.contains(text, F.lit("@"))), "ip": (IP, some), "card": (CARD, some), "phone": (PHONE, F.contains(text, F.lit("+")) & some), "iban": (IBAN, some), "ssn": (SSN, some & F.contains(text, F.lit("-")))}
    gates |= {"nir": (NIR, some), "dni": (DNI, F.regexp_like(text, F.lit("[0-9]{8}-?[A-Z]"))), "tel": (TEL, F.contains(text, F.lit("0"))), "secret": (SECRET, F.regexp_like(text, F.lit("[0-9a-fA-F]{32}|AKIA|gh[pousr]_|github_pat_|sk-")))}
    base = spread(docs.select("doc_id", text_col)).select("doc_id", F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return base.select("doc_id", "text", F.concat(*[_spans(text, k, *gates[k]) for k in KINDS]).alias("spans"))


def personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind,start,end,score>>): a row per input row, spans by kind, then start.

    Offsets are code points, the end is exclusive. A null or empty text has no spans; a row is
    handled alone, so repeated rows give repeated results. Only doc_id and the text are read.
    """
    return _with_spans(docs, text_col).select("doc_id", "spans")


def masked(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, text): every span replaced by `<KIND>`; of overlapping spans the first stands for all.

    A report for people: its cost is that of the text times the spans in it.
    """
    ordered = F.array_sort(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        piece = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, x["start"] - acc["at"]), F.lit("<"), F.upper(x["kind"]), F.lit(">"))
        return F.when(x["start"] < acc["at"], F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["out"].alias("out"))).otherwise(F.struct(x["end"].alias("at"), piece.alias("out")))

    whole = F.aggregate(ordered, zero, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.char_length("text"))))
    return _with_spans(docs, text_col).select("doc_id", whole.alias("text"))
