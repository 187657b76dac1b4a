"""Clean-up of prompts for video models: fillers, shots, locked details, per-shot directives.

All are column expressions. What a later step needs more than once is bound by `_let`: Spark evaluates
an argument of a higher-order function anew for each place it stands in.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed phrases.
FILLERS = """please generate a video of
please create a video of
please make a video of
generate a realistic video where
create a realistic video where
create a realistic video of
generate a video where
generate a video of
create a video where
create a video of
make a video where
make a video of
can you generate a video of
can you create a video of
can you make a video of
i would like to see a video of
i want to see a video of
i want a video of
i want to see
i would like to see
show me a video of
render a video of
please generate
please create""".split("\n")
STOP_WORDS = "just basically actually really very quite literally simply maybe perhaps sort kind".split()
LENS = "shallow depth of field|arri alexa|red v-raptor|red komodo|wide-angle|wide angle|anamorphic|panavision|telephoto|100mm|135mm|16mm|24mm|35mm|50mm|85mm|cooke|arri|macro|imax|bokeh|f/1.4|f/1.8|f/2.8".split("|")
CAMERA = "extreme close-up|over-the-shoulder|tracking shot|crane shot|medium shot|wide-angle|wide angle|low angle|high angle|close-up|steadicam|handheld|gimbal|aerial|dolly|drone|fpv".split("|")
LIGHTING = (
    "volumetric lighting|soft diffused light|cinematic lighting|natural sunlight|dramatic shadows|studio lighting|cyberpunk neon|neon lighting|natural light|high contrast|rim lighting|golden hour|"
    "volumetric|chiaroscuro|rim light|blue hour|neon-lit|god rays|overcast|backlit|moonlit|studio|moody|neon"
).split("|")

#: A shot's camera words, in this order.
CAMERA_OR_LENS = list(dict.fromkeys([*CAMERA, *LENS]))
#: What ends no prompt: white space, the four separators among the controls too.
WHITE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

# Possessive groups run as loops: however often a phrase is repeated, the matcher's stack doesn't grow. The first phrase in list order counts.
FILLER = r"(?i)^(?:(?:" + "|".join(FILLERS) + r")[\p{IsWhite_Space},:-]*+)++"
SUFFIX = r"(?i)(?:, please\.|(?<!,) please\.|, thank you\.|(?<!,) thank you\.)$"
MARKERS = r" [cC]ut to: | [cC]ut to |(?:[Ss]hot|[Ss]cene) (?:1[0-9]|20|[1-9]):"
BREAKS = r"[\n;]|\.(?=\s|\z)"
# What is cut off at the end is tried from the start of a run only, so long runs inside a text cost no more than their length.
BLANK = r"(?U)^\s+|(?<!\s)\s+$"
DOTS = r"(?<!\.)\.+$"
SIGN = r"[^\p{Alnum}\p{L}\p{N}]"
STOP = rf"(?i)^{SIGN}*+(?:{'|'.join(STOP_WORDS)}){SIGN}*+$"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _trim(s: Column) -> Column:
    return F.regexp_replace(s, BLANK, "")


def strip_fillers(text: Column) -> Column:
    """Leading filler phrases, repeatedly, then one polite ending."""
    return _trim(F.regexp_replace(F.regexp_replace(_trim(text), FILLER, ""), SUFFIX, ""))


def condense(shot: Column) -> Column:
    """Without stop words (punctuation around them ignored); white space becomes single spaces."""
    words = F.filter(F.split(_trim(shot), r"(?U)\s+"), lambda w: ~F.regexp_like(w, F.lit(STOP)))
    return F.array_join(words, " ")


def shots(cleaned: Column) -> Column:
    """Array of shots: cut at line feeds, semicolons, sentence ends and explicit markers, never inside decimals."""
    cut = F.split(F.regexp_replace(cleaned, MARKERS, "\n"), BREAKS, -1)
    bare = F.filter(F.transform(cut, lambda s: _trim(F.regexp_replace(_trim(s), DOTS, ""))), lambda s: s != "")
    return F.when(cleaned == "", F.array(F.lit("cinematic establishing shot"))).otherwise(_let(bare, lambda b: F.when(F.size(b) == 0, F.array(cleaned)).otherwise(b)))


def _bounded(spec: str) -> str:
    return rf"(?<![A-Za-z0-9]){re.escape(spec)}(?![A-Za-z0-9])"


def _inside(spec: str, known: list[str]) -> list[str]:
    """The known details that a detail contains on word boundaries, itself included."""
    return [k for k in known if re.search(_bounded(k), spec)]


def _looked_up(found: Column, table: dict[str, list[str]]) -> Column:
    cells = [x for k, values in table.items() for x in (F.lit(k), F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>"))]
    return F.flatten(F.transform(found, lambda k: F.element_at(F.create_map(*cells), k)))


def _found(text: Column, known: list[str]) -> Column:
    """Known details that the text names on word boundaries, by one scan: at each start of a word the longest, which stands for those it contains."""
    any_of = "|".join(re.escape(k) for k in sorted(known, key=len, reverse=True))
    found = F.regexp_extract_all(text, F.lit(rf"(?i)(?<![A-Za-z0-9])(?=({any_of})(?![A-Za-z0-9]))"), F.lit(1))
    return F.array_distinct(F.transform(found, F.lower))


def _listed(known: list[str], test: Callable[[Column], Column]) -> Column:
    """Those that pass, in list order, as text; null if none does."""
    return _let(F.filter(F.array(*[F.lit(k) for k in known]), test), lambda kept: F.when(F.size(kept) > 0, F.array_join(kept, ", ")))


def specs(text: Column, known: list[str]) -> Column:
    """Known details that the text names on word boundaries, longest first; one that a found one contains is left out."""
    named = {k: _inside(k, known) for k in known}
    hidden = {k: list(dict.fromkeys(x for o in named[k] for x in named[o] if known.index(x) > known.index(o))) for k in known}

    def kept(found: Column) -> Column:
        both = F.struct(_looked_up(found, named).alias("named"), _looked_up(found, hidden).alias("hidden"))
        return F.when(F.size(found) > 0, _let(both, lambda b: _listed(known, lambda k: F.array_contains(b["named"], k) & ~F.array_contains(b["hidden"], k))))

    return _let(_found(text, known), kept)


def seen(text: Column, known: list[str]) -> Column:
    """As `specs`, with those that a found one contains."""
    named = {k: _inside(k, known) for k in known}
    return _let(_found(text, known), lambda found: F.when(F.size(found) > 0, _let(_looked_up(found, named), lambda n: _listed(known, lambda k: F.array_contains(n, k)))))


def subject(all_shots: Column) -> Column:
    """The first two clauses of the first shot."""
    clauses = F.filter(F.transform(F.slice(F.split(condense(F.get(all_shots, F.lit(0))), "[,;]", -1), 1, 2), _trim), lambda c: c != "")
    return _let(clauses, lambda found: F.when(F.size(found) == 0, "primary subject").otherwise(F.array_join(found, ", ")))


def compiled(text: Column, seconds: Column | None = None, anchor: Column | None = None) -> Column:
    """The two-section prompt: an XML brief to plan by, and tag-free prompts that repeat the subject in each."""
    seconds = (F.lit(None) if seconds is None else seconds).cast("bigint").cast("string")
    anchor = (F.lit(None) if anchor is None else anchor).cast("string")

    def details(clean: Column) -> Column:
        return F.struct(shots(clean).alias("cut"), specs(clean, LENS).alias("lens"), specs(clean, LIGHTING).alias("light"))

    def info(d: Column) -> Column:
        return F.struct(subject(d["cut"]).alias("subject"), F.transform(d["cut"], condense).alias("shots"), d["lens"].alias("lens"), d["light"].alias("light"))

    return F.when(text.isNotNull(), _let(_let(_let(strip_fillers(text), details), info), lambda i: _assembled(i, seconds, anchor)))


def _some(*parts: str | Column) -> Column:
    """The parts joined; nothing if one of them is null."""
    return F.coalesce(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]), F.lit(""))


def _assembled(info: Column, seconds: Column, anchor: Column) -> Column:
    who, lens, light = info["subject"], info["lens"], info["light"]
    extra = [F.when(~F.contains(F.lower(who), v), F.concat(F.lit(", "), v)) for v in (lens, light)]
    identity = F.concat(who, *[F.coalesce(v, F.lit("")) for v in extra])

    def brief(shot: Column, k: Column) -> Column:
        first = F.when(anchor != "", anchor).otherwise("initial_keyframe")
        return F.concat(
            F.lit('  <shot index="'), (k + 1).cast("string"), F.lit('"'), _some(' duration="', seconds, 's"'), F.lit(">\n"), _some("    [Camera: ", F.coalesce(seen(shot, CAMERA_OR_LENS), lens), "]\n"),
            F.lit("    [Motion: "), F.when(shot == "", "natural subject motion").otherwise(shot), F.lit("]\n    [Continuity: anchor="), F.when(k == 0, first).otherwise("sharpest_tail_frame"), F.lit(", lock=character_lock]\n  </shot>\n"),
        )

    def paste(shot: Column, k: Column, same: Column) -> Column:
        tail = F.when(F.startswith(shot, who), F.ltrim(F.substring(shot, F.length(who) + 1, F.length(shot)), F.lit(" \t\n\r\f\v,;"))).otherwise(shot)
        return F.concat(F.lit("Shot "), (k + 1).cast("string"), F.lit(": "), same, _let(tail, lambda t: F.when(t != "", F.concat(F.lit(", "), t)).otherwise("")), _some(" (", seconds, "s)"), _some(" [Conditioning Image: ", anchor, "]"))

    text = F.concat(
        F.lit("# 1. Prompt-Writer Brief (XML for LLM planning)\n<video_brief>\n  <character_lock>\n    subject: "), who, _some("\n    lens: ", lens), _some("\n    lighting: ", light), F.lit("\n  </character_lock>\n"),
        F.array_join(F.transform(info["shots"], brief), ""), F.lit("</video_brief>\n\n# 2. Paste-Ready Video Model Prompts (No XML tags — repeat identity per clip)\n"),
        _let(identity, lambda same: F.array_join(F.transform(info["shots"], lambda s, k: paste(s, k, same)), "\n")),
    )
    return F.rtrim(text, F.lit(WHITE))
