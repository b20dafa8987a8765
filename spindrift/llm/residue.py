"""Template residue: texts with unfilled placeholders, filler, error messages or script notices in place of content.

1. Each text is read whole, in Arrow batches.  A placeholder left unfilled, or
   an editor's note in its place, makes it a ``slot``, if it stands outside
   quotations and code listings.  One is enough.
2. Of any other text the navigation, heading and footer are taken off, numbers,
   addresses and dates masked, and every sentence of the rest is judged by the
   roles of its words (``wording``): message, weak, or of its own.  For texts
   that may be residue the sentences are hashed, for all texts the whole rest.
3. Equal hashes are grouped across all texts and sources.  A sentence that
   recurs widely (LOOSE_TEXTS texts, LOOSE_SOURCES sources) where nothing else
   stands is judged with less of its wording known; a rest of weak phrases alone
   (loading, redirecting) counts when it recurs (RECUR_TEXTS, RECUR_SOURCES); and
   a rest in any wording when it stands in EVERYWHERE of all texts (at least
   EVERYWHERE_TEXTS) and half of the sources.
4. A text is residue if messages are left, sentences of its own have at most
   OWN_SHARE of the letters and their unknown words at most NOISE_SHARE, and none
   of them is prose: of PROSE_WORDS words or more, most of them unknown.

Shares are of the whole text and no rule depends on its length, so that a text
repeated, or put amid navigation, is judged as before.

Headings and footers are the first and last lines that recur in their source
(in EDGE_TEXTS of its texts with as many different rests, and in EDGE_SHARE of
all its texts), whatever their wording; besides them a first line of up to
HEADING_WORDS words that doesn't end as a sentence, and lines with ©.  Each
text is judged as it is and without its first, its last and both lines; once
the recurring ones are known, the allowed judgements count.

Partial counts are formed before each shuffle, so a hash that a third of the
texts share is cheap.  Null, empty and blank texts are never residue.  Rows are
kept as they come (a repeated id comes out as often as it is flagged,
``flagged`` makes it distinct).  Null sources count as one source.
"""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift import skew
from spindrift.llm import wording

RECUR_TEXTS = 3
RECUR_SOURCES = 2
LOOSE_TEXTS = 5
LOOSE_SOURCES = 3
#: One in so many of all texts; at most as many rests can stand in that many.
EVERYWHERE, EVERYWHERE_TEXTS = 100, 10
#: Texts, and one in so many of a source's texts, that a line must begin or end to be a heading or footer.
EDGE_TEXTS, EDGE_SHARE = 3, 10
#: Part of the letters that may be in sentences of a text's own, and in unknown words of these (names, broken words); words from which a sentence of a text's own is
#: content whatever its part (Chinese and Japanese: letters) and the part of it that must be unknown, and words of a heading.
OWN_SHARE, NOISE_SHARE, PROSE_WORDS, PROSE_LETTERS, PROSE_SHARE, HEADING_WORDS = 0.4, 0.2, 6, 12, 0.5, 6

# ---------------------------------------------------------------- placeholders

_NOUNS = """title author summary company city price date name link headline subtitle product id email alt category count url address phone amount street country zip password username subject message description content
text body location venue logo caption number quantity total currency rating tag tags image photo slug year month day time user customer client order item page site signature placeholder todo tbd tba firstname lastname
bio introduction intro copy details info quote testimonial button website department position salutation greeting vorname nachname firma ort datum telefon anrede betreff text texte nom prenom prénom société ville texto nombre apellido
empresa ciudad fecha имя фамилия компания город дата текст заголовок""".split()
_PRE = "page user site first last full item order image product company customer client event article post meta main sub short your the email phone job contact street zip project brand business recipient sender account invoice".split()
#: What the name in a weakly marked slot ([x], <x>, {x}) must be, letters only; compounds are sure even where a lone noun isn't.
_COMPOUND = {p + n for p in _PRE for n in _NOUNS} | {"firstname", "lastname", "username"}
_SLOT_NAMES = {*_NOUNS, *_COMPOUND}
_IDENT = r"[^\W\d_][^\W_]*(?:[ _.\-]{1,2}[^\W_]+){0,3}"
_CONTROL = re.compile(r"^(?:for|if|else|elif|elseif|end\w*|block|extends|include|macro|set|while|each|unless|raw|import|from|load|with|comment)\b")
_STRONG_SLOT = re.compile(
    rf"\{{\{{\{{?\s*({_IDENT})\s*\}}?\}}\}}|[$#]\{{\s*({_IDENT})\s*\}}|\{{[$!]\s*({_IDENT})\s*\}}|%%\s*({_IDENT})\s*%%|@@\s*({_IDENT})\s*@@|\#\#\s*({_IDENT})\s*\#\#|<%=?\s*({_IDENT})\s*%>|\{{%\s*({_IDENT})\s*%\}}|\[\[\s*({_IDENT})\s*\]\]|\*\|\s*({_IDENT})\s*\|\*"
)
_WEAK_SLOT = re.compile(rf"\[\s*({_IDENT})\s*\]|<\s*({_IDENT})\s*>|(?<![{{$#\\^_\w])\{{\s*({_IDENT})\s*\}}|«\s*({_IDENT})\s*»|\$({_IDENT})\$|__({_IDENT})__|(?<![\w%])%({_IDENT})%")
_LONE_SLOT = re.compile(r"(?<![\w$])\$([a-z]+(?:_[a-z]+)*)\b")
#: Words right before a slot that is spoken of, not left unfilled.
_MENTIONS = re.compile(r"\b(?:writes?|writing|wrote|types?|typing|uses?|using|like|such as|variables?|placeholders?|tags?|tokens?|syntax|schreibt|wie|écrit|escribe)\s$")
#: Numbered slots, of which one alone may be a set.
_NUMBERED = re.compile(r"(?<![\w^_\\{}$])\{\d\}(?![\w{}])")
_NOTE_MARKED = re.compile(
    r"\[\s*(?:your|insert|ins[eé]r\w*|insert\w*|ihre?n?|votre|hier|aquí|enter|add|type|put|placeholder|write)\b[^\]\n]+\]"
    r"|\(\s*(?:insert|aquí va|insér\w+|hier)\s[^)\n]+\)"
    r"|<\s*(?:type|enter|insert|your)\s(?:the\s|an?\s)?[^>\n]+>"
)
#: Words that must be there for a note to be, and the note.
_NOTES = (
    ("do", re.compile(r"\b(?:to\s?do|to-do)\s*:\s*(?:write|add|insert|fill|complete|replace|provide|update|finish|describe|check)\b|\btodo\s*:")),
    ("fixme", re.compile(r"\bfixme\b\s*[:–—-]")),
    ("tb", re.compile(r"\btb[dca]\s*[–—:-]")),
    ("editor", re.compile(r"\bto (?:follow|come) from the editor\b")),
)
#: Somebody is told to put a thing in: the thing is the group.
_PUT = re.compile(
    r"\b(?:enter|insert|add|type|write|put|paste|place)\s+(?:your\s+|the\s+|an?\s+|some\s+|more\s+)?((?:[a-z]+ ){0,4}?[a-z]+)\s+(?:here|below|for this (?:section|page|field|block))\b"
    r"|\badd your ([^.\n]+?) (?:text|copy|content)(?: here)?(?=$|[\s.])"
    r"|\byour ((?:[a-z]+ ){0,3}[a-z]+) here\b|\bihre?n? ([^\W\d_]+) hier\b|\bvotre ([^\W\d_]+) ici\b|\b[st]u ([^\W\d_]+) aquí\b|\bваш[а-я]* ([^\W\d_]+) здесь\b"
    rf"|({_IDENT}) goes here\b"
)
_CJK_PUT = re.compile("在此(?:处)?(?:输入|填写|插入)|请(?:在此)?填写(?:标题|内容|名称)|ここに[^。\n]{0,12}(?:入力|記入|挿入)")
_FENCE = re.compile(r"```.*?```|`[^`\n]+`", re.S)
_QUOTED = re.compile(r"„[^“”\n]+[“”]|“[^”\n]+”|(?<![^\s(\[—–-])\"(?=\S)[^\"\n]*(?<=\S)\"(?!\w)|「[^」\n]+」|‘[^’\n]+’")
_PAIRED_TAG = re.compile(r"<\s*([a-z][a-z0-9]*)\b[^>]*>(.*?)<\s*/\s*\1\s*>", re.S)
_BLANKS = re.compile(r"[ \t\xa0]{2,}")
#: Strings of which a strong, a weak slot, a marked note and a note in words have at least one.
_STRONG_MARKS = ("{{", "${", "#{", "{$", "{!", "%%", "@@", "##", "<%", "{%", "[[", "*|")
_MARK_CHARACTERS = "{[<(%$#@*«"
_WEAK_MARKS = ("[", "<", "{", "«", "$", "%", "__")
_NOTE_MARKS = ("[", "<", "(ins", "( ins", "(hier", "(aqu", "( aqu")
_NOTE_WORDS = (" here", "tbd", "tbc", "tba", "todo", "to do", "to-do", "fixme", "add your", "for this ", "from the editor", " hier", " ici", " aquí", "здесь", "在此", "请", "ここに")
_BLOCK_TAG = re.compile(r"\{%-?\s*(\w+)[^%]*%\}")
_LISTED_TAGS = re.compile(r"(?:<([a-z][a-z0-9]*)[^>\n]*>[^<\n]*</\s*\1\s*>\s*)+$")
_OPENS = frozenset("for if block macro while each unless raw with comment".split())


def _without_blocks(t: str) -> str:
    """``t`` without template blocks ({% for ... %} to {% endfor %}) and the tags listed right before them; one pass, blocks of any length."""
    out, at, open_at, depth = [], 0, 0, []
    for m in _BLOCK_TAG.finditer(t):
        word = m.group(1)
        if word in _OPENS:
            if not depth:
                open_at = m.start()
            depth.append(word)
        elif word.startswith("end") and depth and (word == "end" or word[3:] in depth):
            while depth:
                last = depth.pop()
                if word in ("end", f"end{last}"):
                    break
            if not depth:
                before = t[at:open_at]
                listed = _LISTED_TAGS.search(before) if before.rstrip().endswith(">") else None
                out.append(before[: listed.start()] if listed else before)
                at = m.end()
    return " ".join([*out, t[at:]])


def _is_slot_name(name: str, names: set = _SLOT_NAMES) -> bool:
    words = [w for w in re.split(r"[ _.\-]+", name) if w]
    return any("".join(words[-k:]) in names for k in (1, 2, 3))


def has_slot(canonical: str) -> bool:
    """Whether a canonical text has an unfilled slot or an editor's note outside quotations and code."""
    noted = any(x in canonical for x in _NOTE_WORDS)
    strong = weak = marked = False
    if any(c in canonical for c in _MARK_CHARACTERS) or "__" in canonical:
        strong, weak, marked = (any(x in canonical for x in marks) for marks in (_STRONG_MARKS, _WEAK_MARKS, _NOTE_MARKS))
    if not (strong or weak or marked or noted):
        return False
    t = _without_blocks(canonical) if "{%" in canonical else canonical
    t = _FENCE.sub(" ", t) if "`" in t else t
    t = _BLANKS.sub(" ", t)
    t = _QUOTED.sub(" ", t)
    if strong:
        for m in _STRONG_SLOT.finditer(t):
            name = next(g for g in m.groups() if g)
            if not (m.group().startswith("{%") and _CONTROL.match(name)) and not _MENTIONS.search(t, max(0, m.start() - 24), m.start()):
                return True
    if marked and _NOTE_MARKED.search(t) or noted and any(w in t and note.search(t) for w, note in _NOTES):
        return True
    if noted:
        for m in _PUT.finditer(t):
            if _is_slot_name(next(g for g in m.groups() if g)):
                return True
        if not t.isascii() and _CJK_PUT.search(t):
            return True
    if not weak:
        return False
    if "<" in t and "</" in t:
        t = _PAIRED_TAG.sub(r" \2 ", _PAIRED_TAG.sub(r" \2 ", t))
    for m in _WEAK_SLOT.finditer(t):
        name = next(g for g in m.groups() if g)
        if re.sub(r"[\W\d_]", "", name) in _SLOT_NAMES and not _MENTIONS.search(t, max(0, m.start() - 24), m.start()):
            return True
    if "$" in t and any(m.group(1).replace("_", "") in _COMPOUND for m in _LONE_SLOT.finditer(t)):
        return True
    return "{" in t and len({m.group() for m in _NUMBERED.finditer(t)}) > 1


# ---------------------------------------------------------------- sentences

_ZERO = re.compile("[\u200b-\u200f\u202a-\u202e\u2060\ufeff\u180e]")
_LINES = re.compile("[^\n\r\x0b\x0c\x85\u2028\u2029]+")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？!])|\s[–—|»]\s|(?<=:)\s+")
#: Where two sentences are glued together.
_GLUED = re.compile(r"(?<=[^\W\d_]{2}[.!?])(?=[^\W\d_]{2})")
_END = re.compile(r"[.!?。！？]\s*$")
_ADDRESS = re.compile(r"https?\s*:\s*//\S+|www\.\S+|\S+@\S+|(?:^|(?<=\s))/[\w./~%-]+")
_HOST_END = re.compile(r"\.(?:example|com|org|net|html?|php|py|java)\b")
_HOST = re.compile(r"(?<![\w.-])[\w-]+(?:\.[\w-]+)*\.(?:example|com|org|net|html?|php|py|java)\b\S*")
_DIGIT = re.compile(r"\d")
_NUMBER = re.compile(r"\b(?:\d{1,2} )?(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]* \d{2,4}\b|\b(?=[0-9a-f]*\d)[0-9a-f]{5,}\b|\d+")
_TAG = re.compile(r"</?\s*[a-z][a-z0-9]*(?:\s[^<>]*)?/?>")
#: Names of code in a line of a trace: dotted, underscored, called.
_CODE_NAME = re.compile(r"[^\W\d][\w$]*(?:(?:\.|::|->|\\)[\w$<>]+)+(?:\([^()\n]*\))?|\w+_\w+(?:\([^()\n]*\))?|[^\W\d]\w*\([^()\n]*\)")
_CODE_MARK = re.compile(r"[_(\\]|::|->|^\s*at\s|\w\.\w+\.\w")
_QUOTE_MARK = re.compile("[\"'`„“「‘]")
_SINGLE_QUOTED = re.compile(r"(?<![\w’'])'[^'\n]+'(?!\w)")
_NAV = re.compile(r"(?:home|news|sitemap|search|login|logout|signin|signup|register|contact|contactus|page|menu|about|aboutus|imprint|impressum|privacy|terms|help|faq|blog|shop|archive|index|next|previous|back|top|startseite|kontakt|suche|accueil|recherche|inicio|buscar|contacto|главная|поиск|контакты|首页|搜索|ホーム|検索)+")
_WORDS = re.compile(r"[^\W\d_]+")
_NO_LETTERS = bytes(c for c in range(128) if not chr(c).isalpha())
#: Digits with which masking takes letters away.
_LETTERED = re.compile(r"[a-f]\d|\d[a-f]|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]* \d\d")


def _canonical(text: str) -> str:
    if text.isascii():
        return (html.unescape(text) if "&" in text else text).lower()
    t = _ZERO.sub(" ", text.replace("\u00ad", ""))
    t = unicodedata.normalize("NFKC", t)
    return (html.unescape(t) if "&" in t else t).lower()


def _mask(line: str) -> str:
    """Addresses, dates, hexadecimal ids and numbers to blanks."""
    if "/" in line or "@" in line or "www." in line:
        line = _ADDRESS.sub(" ", line)
    if _HOST_END.search(line):
        line = _HOST.sub(" ", line)
    return _NUMBER.sub(" ", line) if _DIGIT.search(line) else line


def _masks_letters(line: str) -> bool:
    """Whether masking takes away more than digits."""
    return "/" in line or "@" in line or "www." in line or "." in line and _HOST_END.search(line) is not None or _DIGIT.search(line) is not None and _LETTERED.search(line) is not None


def _letters(s: str) -> str:
    if s.isascii():
        return s.encode().translate(None, _NO_LETTERS).decode()
    return "".join(_WORDS.findall(s))


def _sentences(line: str) -> Iterator[str]:
    """Lazily, so that a long line is read only as far as its first sentence of content."""
    at = 0
    for m in _SENTENCE.finditer(line):
        if m.start() > at:
            yield line[at : m.start()]
        at = m.end()
    yield line[at:]


@dataclass
class Unit:
    """A sentence: its hash, letters and unknown ones, kind, kind if it recurs widely, the line it is in (1 first, 2 last, 3 only one), and whether it is prose."""

    hash: int
    letters: int
    unknown: int
    kind: int
    wide: int
    place: int
    prose: bool


@dataclass
class Reading:
    """``kind`` is slot, text (content whatever recurs), maybe, or null (nothing to judge)."""

    kind: str | None
    units: list[Unit] = field(default_factory=list)
    rests: list[int | None] = field(default_factory=list)
    head: str | None = None
    foot: str | None = None


def _body(canonical: str) -> list[tuple[str, str]]:
    """(line, masked letters) of every line that is neither navigation nor marked by ©."""
    out = []
    for found in _LINES.finditer(canonical):
        raw = found.group()
        line = _TAG.sub(" ", raw) if "<" in raw else raw
        if "©" in line and line.lstrip().startswith("©") and len(line.split()) <= HEADING_WORDS + 2:
            continue
        flat = _letters(_mask(line) if _masks_letters(line) else line)
        if flat and not _NAV.fullmatch(flat):
            out.append((line, flat))
    return out


def _code_name(m: re.Match) -> str:
    """A name of code is masked; an exception's says what it is."""
    return " exception " if re.search(r"(?:exception|error)\b", m.group()) else " "


def _pieces(line: str) -> Iterator[str]:
    """The sentences of a line, masked; lazily, and from the first quotation mark on without quotations and code."""
    at = 0
    for m in _SENTENCE.finditer(line):
        if _QUOTE_MARK.search(line, at, m.start()):
            break
        if m.start() > at:
            yield line[at : m.start()]
        at = m.end()
    rest = line[at:]
    if _QUOTE_MARK.search(rest):
        rest = _FENCE.sub(" ", _SINGLE_QUOTED.sub(" ", _QUOTED.sub(" ", rest)))
    yield from _sentences(rest)


def _units(line: str, place: int) -> Iterator[Unit]:
    for piece in _pieces(line):
        masked = _mask(piece) if _masks_letters(piece) else piece
        if _CODE_MARK.search(masked):
            masked = _CODE_NAME.sub(_code_name, masked)
        for sentence in _GLUED.split(masked):
            flat = _letters(sentence)
            if not flat or _NAV.fullmatch(flat):
                continue
            words = wording.tokens(sentence)
            j = wording.judge(sentence, words)
            cjk = sum(map(len, wording._CJK.findall(sentence))) if not sentence.isascii() else 0
            long = cjk >= PROSE_LETTERS if cjk else len(words) >= PROSE_WORDS
            yield Unit(_hash(flat), j.letters, j.unknown, j.kind, j.wide, place, long and j.unknown >= PROSE_SHARE * j.letters)


def _hash(rest: str | None) -> int | None:
    return None if rest is None else int.from_bytes(hashlib.blake2b(rest.encode(), digest_size=8).digest(), "big", signed=True)


def _is_heading(line: str) -> bool:
    return len(_WORDS.findall(_mask(line))) <= HEADING_WORDS and not _END.search(line)


def _kept(units: list[Unit], off: int, recurring: frozenset | set) -> list[tuple[Unit, int]]:
    """The units without those of the lines taken off (1 first, 2 last), with the kind that counts."""
    return [(u, u.wide if u.hash in recurring else u.kind) for u in units if not (u.place & off and u.place != 3)]


def _verdict(units: list[Unit], off: int = 0, recurring: frozenset | set = frozenset()) -> str | None:
    """message, soft (weak phrases alone), or null for content."""
    kept = _kept(units, off, recurring)
    total = sum(u.letters for u, _ in kept)
    own = [u for u, k in kept if k == wording.OWN]
    if any(u.prose for u in own) or sum(u.unknown for u in own) > NOISE_SHARE * total or sum(u.letters for u in own) > OWN_SHARE * total:
        return None
    kinds = {k for _, k in kept}
    if wording.MESSAGE in kinds:
        return "message"
    return "soft" if kinds == {wording.WEAK} else None


def reading(text: str | None, source: str | None = None) -> Reading:
    """What one text says before anything is known of the others."""
    if text is None or not text.strip():
        return Reading(None)
    t = _canonical(text)
    if has_slot(t):
        return Reading("slot")
    lines = _body(t)
    if not lines:
        return Reading(None)
    n = len(lines)
    flats = [f for _, f in lines]
    if n == 1:
        rests, head, foot = [flats], None, None
    else:
        rests, head, foot = [flats, flats[1:], flats[:-1], flats[1:-1]], f"{source}\0head\0{flats[0]}", f"{source}\0foot\0{flats[-1]}"
    out = Reading("text", [], [_hash("|".join(r)) if r else None for r in rests], head, foot)
    # content as soon as the lines between the first and the last show it; what they have of letters bounds the shares
    most = NOISE_SHARE * sum(map(len, flats))
    own = 0
    units: list[Unit] = []
    for i in [*range(1, n - 1), 0, *range(n - 1, n)[: n > 1]]:
        place = 3 if n == 1 else 1 if i == 0 else 2 if i == n - 1 else 0
        if i == 0 and n > 1 and _is_heading(lines[0][0]):
            found = list(_units(lines[0][0], place))
            units += [u for u in found if u.kind != wording.OWN]
            continue
        for u in _units(lines[i][0], place):
            units.append(u)
            if u.wide == wording.OWN and place in (0, 3):
                own += u.unknown
                if u.prose or own > most:
                    return out
    wide = {u.hash for u in units}
    if any(_verdict(units, off, known) for off in range(4 if n > 1 else 1) for known in (frozenset(), wide)):
        out.kind, out.units = "maybe", units
    return out


def classify(text: str | None) -> tuple[str | None, int | None]:
    """(slot, message, soft or null, hash of the rest) of a text by itself, nothing being known of others."""
    r = reading(text)
    kind = "slot" if r.kind == "slot" else _verdict(r.units) if r.units else None
    return kind, r.rests[0] if kind and r.rests else None


def read(text: str | None) -> tuple[str | None, int | None]:
    """As :func:`classify`, with ``loose`` for what would be a message if its sentences recurred widely, and ``text`` for all other content."""
    r = reading(text)
    kind = classify(text)[0]
    if kind is None and r.kind:
        kind = "loose" if r.units and _verdict(r.units, 0, {u.hash for u in r.units}) == "message" else "text"
    return kind, r.rests[0] if r.rests else None


# ---------------------------------------------------------------- all texts together

_UNIT = "array<struct<hash:bigint,letters:int,unknown:int,kind:tinyint,wide:tinyint,place:tinyint,prose:boolean>>"
_UNIT_PA = pa.list_(pa.struct([("hash", pa.int64()), ("letters", pa.int32()), ("unknown", pa.int32()), ("kind", pa.int8()), ("wide", pa.int8()), ("place", pa.int8()), ("prose", pa.bool_())]))


def _read_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    row = TaskContext.get().partitionId() << 40
    for b in batches:
        made = [reading(t, s) for s, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [
                b.column(0), b.column(1), pa.array(range(row, row + len(made)), pa.int64()), pa.array([r.kind for r in made], pa.string()),
                pa.array([[vars(u) for u in r.units] for r in made], _UNIT_PA), pa.array([r.rests for r in made], pa.list_(pa.int64())),
                pa.array([_hash(r.head) for r in made], pa.int64()), pa.array([_hash(r.foot) for r in made], pa.int64()),
            ],
            names=["id", "source", "row", "kind", "units", "rests", "head", "foot"],
        )
        row += len(made)


def edges(readings: DataFrame) -> DataFrame:
    """(edge): the first and last lines that are their source's headings and footers, at most 2 x EDGE_SHARE of a source."""
    sizes = readings.groupBy("source").agg(F.count(F.lit(1)).alias("size")).select(F.col("source").alias("of"), "size")
    each = readings.select("source", F.col("rests")[0].alias("rest"), F.explode(F.array("head", "foot")).alias("edge")).filter("edge is not null")
    by_body = each.groupBy("edge", "source", "rest").agg(F.count(F.lit(1)).alias("n"))
    found = by_body.groupBy("edge", "source").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("bodies")).filter(F.col("bodies") >= EDGE_TEXTS)
    return found.join(sizes, F.col("source").eqNullSafe(F.col("of"))).filter(F.col("n") * EDGE_SHARE >= F.col("size")).select("edge").distinct()


def recurring(judged: DataFrame) -> DataFrame:
    """(rest, n_texts, n_sources) of every hash, over all texts and sources."""
    by_source = judged.filter("rest is not null").groupBy("rest", "source").agg(F.count(F.lit(1)).alias("n"))
    return by_source.groupBy("rest").agg(F.sum("n").alias("n_texts"), F.count(F.lit(1)).alias("n_sources"))


def _wide_units(readings: DataFrame) -> DataFrame:
    """(row, recurring): of each text that may be residue the sentences that recur widely in such texts."""
    unknown = F.filter("units", lambda u: (u["wide"] == wording.MESSAGE) & (u["kind"] != wording.MESSAGE))
    each = readings.filter("kind = 'maybe'").select("row", "source", F.explode(F.array_distinct(F.transform(unknown, lambda u: u["hash"]))).alias("rest"))
    wide = recurring(each).filter((F.col("n_texts") >= LOOSE_TEXTS) & (F.col("n_sources") >= LOOSE_SOURCES)).select("rest")
    side = skew.lookup_join(each.select("row", "rest"), wide, "rest", "left_semi", hot_in=each.select("rest"), spread=["row"])
    return side.groupBy("row").agg(F.collect_set("rest").alias("recurring"))


def _judge_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        kinds, rests = [], []
        for kind, units, every, recur, head, foot in zip(*[b.column(i).to_pylist() for i in range(2, 8)]):
            allowed = [off for off in range(len(every or ())) if (head or not off & 1) and (foot or not off & 2)]
            rest = every[allowed[-1]] if allowed else None
            if kind == "maybe":
                kind = "text"
                made = [Unit(**u) for u in units]
                # the text as it is first, then with more taken off; a known message before one known by recurrence
                for name, known in (("message", frozenset()), ("loose", set(recur or ())), ("soft", set(recur or ()))):
                    at = next((o for o in allowed if _verdict(made, o, known) == ("soft" if name == "soft" else "message")), None)
                    if at is not None:
                        kind, rest = name, every[at]
                        break
            kinds.append(kind)
            rests.append(rest)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(kinds, pa.string()), pa.array(rests, pa.int64())], names=["id", "source", "kind", "rest"])


def judge(documents: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", recur_texts: int = RECUR_TEXTS, recur_sources: int = RECUR_SOURCES) -> DataFrame:
    """(key, kind, n_texts, n_sources, residue) for every text that is a slot, message, loose (known by recurrence) or soft rest, or stands everywhere.

    ``n_texts`` and ``n_sources`` say how widely its masked rest recurs;
    ``residue`` is the verdict.
    """
    from spindrift.session import materialize

    kind = documents.schema[key].dataType.simpleString()
    given = documents.select(F.col(key).alias("id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    # small tables (no texts): the headings and footers, the grouping and the verdict read them
    schema = f"id {kind}, source string, row long, kind string, units {_UNIT}, rests array<long>, head long, foot long"
    readings = materialize(given.mapInArrow(_read_all, schema).filter("kind is not null"), "residue-read")
    known = materialize(edges(readings), "residue-edges")
    wide = materialize(_wide_units(readings), "residue-wide")
    rows = readings
    for side in ("head", "foot"):
        rows = skew.lookup_join(rows, known.select(F.col("edge").alias(side), F.lit(True).alias(f"{side}_off")), side, "left", hot_in=readings, spread=["row"])
    rows = skew.lookup_join(rows, wide, "row", "left", hot_in=readings.select("row").limit(0))
    columns = ["id", "source", "kind", "units", "rests", "recurring", F.coalesce("head_off", F.lit(False)).alias("h"), F.coalesce("foot_off", F.lit(False)).alias("f")]
    judged = materialize(rows.select(*columns).mapInArrow(_judge_all, f"id {kind}, source string, kind string, rest long"), "residue")
    groups = recurring(judged)
    suspicious = judged.filter("kind <> 'text'")
    joined = skew.salted_join(suspicious, groups, "rest", "left", hot=skew.hot_keys(suspicious, "rest"), spread=["id"])
    # of the other texts only rests that stand everywhere matter: at most EVERYWHERE of them
    all_texts, all_sources = judged.groupBy("source").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    everywhere = (F.col("n_texts") >= EVERYWHERE_TEXTS) & (F.col("n_texts") * EVERYWHERE >= F.lit(all_texts)) & (F.col("n_sources") * 2 >= F.lit(all_sources))
    rest = judged.filter("kind = 'text'").join(F.broadcast(groups.filter(everywhere)), "rest")
    recurs = (F.col("n_texts") >= recur_texts) & (F.col("n_sources") >= recur_sources)
    verdict = F.col("kind").isin("slot", "message", "loose") | F.coalesce(((F.col("kind") == "soft") & recurs) | everywhere, F.lit(False))
    cols = ["id", "kind", "n_texts", "n_sources"]
    return joined.select(*cols).unionByName(rest.select(*cols)).select(F.col("id").alias(key), "kind", "n_texts", "n_sources", verdict.alias("residue"))


def flagged(documents: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(key) of the texts that are template residue, each once."""
    return judge(documents, key, source, text).filter("residue").select(key).distinct()
