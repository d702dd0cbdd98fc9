"""Personal data in free text: where it is, and the text with typed placeholders.

Information-theoretic sanitisation. Forms give candidates: anything that may be a mailbox, a telephone number, an
identity number, an address or a person's name. What a candidate reveals is estimated from the corpus, for every kind
alike: for its form, for the words beside it and for its own words, the number of different candidates that they occur
with, and how many of these are protected entities. The pointwise mutual information of a term and a protected entity,
in bits, is what the term discloses; a candidate whose terms together pass the threshold of its kind is generalised to
its kind. Anchors of the estimate are an unmistakable format or a label beside a number, and a listed given name;
the form of an anchor is a term like any other, which what stands beside it may outweigh. All counts are over different
candidates, so copies of a document add nothing, and a candidate never counts as evidence for itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.session import written

PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}
#: Different candidates that a term needs, besides the one it is evidence for, to say anything.
SUPPORT = 3
#: Share of capitalised runs and of numbers that would be protected if nothing were known about them.
PRIOR = 1 / 32
#: The same for candidates of an unmistakable form and for those with a listed given name, before any were counted.
FORM_PRIOR, GIVEN_PRIOR = 1 / 2, 1 / 4
#: Capitalised words of one name at most; longer runs are cut and their parts judged.
LONGEST = 8
#: Bits that a name needs in all, the bits that its family name or what follows it must give, and the bits that any
#: other candidate needs, of which a name without letter case is one.
NAME_BITS, NAME_KEY_BITS, OTHER_BITS = 6.0, 2.0, 4.0
#: Signs for what stands beside a name, of no script.
SIGNS = {"email": "\ue000", "phone": "\ue001", "id_number": "\ue002", "address": "\ue003"}
#: Parts that a frequent term or signature is spread over in a join.
SALTS = 16
#: Lines whose candidates a Python worker keeps.
LINES_KEPT = 1 << 16

# ---- fixed values: words and formats of addresses, organisations and names -----------------------------------

STREETS = "Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Boulevard|Blvd|Drive|Dr|Court|Ct|Close|Terrace|Way|Place|Pl|Square|Sq|Crescent|Row|Parkway|Highway|Hill|Walk|Mews|Gardens"
VOIES = "rue|avenue|impasse|boulevard|allée|chemin|place|quai|cours|route|square|passage|ruelle|sentier"
STRASSEN = "straße|strasse|str\\.|weg|gasse|platz|allee|damm|ufer|ring|steig|graben|pfad"
LAGEN = "Am|An der|An den|Auf dem|Auf der|Hinter den|Hinter dem|Hinter der|Im|In der|In den|Unter den|Vor dem|Vor der|Zum|Zur|Bei der|Beim"
ORGANISATIONS = frozenset(
    "Association Authors Bank Board Centre Center Club Collective College Committee Company Consortium Contributors Cooperative Corp Corporation "
    "Department Developers Foundation GmbH Group Guild Inc Institute Lab Laboratory Labs Licence License Limited LLC Ltd Maintainers Network "
    "Organisation Organization Partners Project Society Team Trust University".split()
)
#: Words that name an identity number, as they stand beside it.
LABELS = frozenset(
    "aadhaar bsn carnet cedula cpf curp dni document documento driver fiscal id identity idnr insurance ins licence nat national ni nie nif nin nino "
    "passport pasaporte passeport paß pass pesel personnummer reisepass sec security sin sozialversicherungsnummer ssn steuer "
    "steueridentifikationsnummer steuernummer sv tax taxpayer tfn travel инн паспорт снилс ss".split()
)
PARTICLES = "al|bin|da|de|del|den|der|di|du|el|la|le|ten|ter|van|von|zu|zum"

#: An escape in a string literal ends what stands before it.
ESCAPE = r"(?<=\\[tnr])"
LOCAL = r"[\p{L}\p{N}](?:[\p{L}\p{N}._+\-]*[\p{L}\p{N}])?"
LABEL = r"[\p{L}\p{N}](?:[\p{L}\p{N}\-]*[\p{L}\p{N}])?"
SIGN_AT = r"(?:@|＠|%40|&\#64;|&\#x40;|&commat;|\ @\ |\s?[\[({<]\s?(?:at|AT|@)\s?[\])}>]\s?|_at_|_AT_)"
SIGN_DOT = r"(?:\.|\s?[\[({]\s?(?:dot|DOT|\.)\s?[\])}]\s?|_dot_)"
WORD_DOT = r"(?:\s(?:dot|DOT|Dot)\s)"
EMAIL = regex.compile(
    rf"(?:(?<![\p{{L}}\p{{N}}._+%\-])|{ESCAPE})(?P<l>{LOCAL})(?:{SIGN_AT}(?P<d>{LABEL}(?:(?:{SIGN_DOT}|{WORD_DOT}){LABEL})+)|\s(?:at|AT|At)\s(?P<e>{LABEL}(?:(?:{WORD_DOT}|{SIGN_DOT}){LABEL})*{WORD_DOT}{LABEL}))"
)
WORD_AT = re.compile(r"[\[({<_ ](?:at|AT|At)[\])}>_ ]")
SIX_DIGITS = re.compile(r"(?:\d[\s.\-\u2010\u2011\u2013/()]{0,3}){6}")
DIGIT = re.compile(r"\d")
ADDRESS_HINT = re.compile(r"[^\W\d_a-z][^\s,]* \d|\d[A-Za-z]?,? (?:[^\W\d_a-z]|[a-zà-ÿ]{3,9}[ ,])")

GAP = r"[ \u00a0\u2009\u202f.\-\u2010\u2011\u2013]"
PHONE = regex.compile(
    rf"""(?:(?<![\p{{L}}\p{{N}}_+])(?<!\d[.\-/:,(])|{ESCAPE})(?:
      \+\d{{1,3}}{GAP}?(?:\(0\){GAP}?)?(?:\(\d{{1,4}}\){GAP}?)?\d(?:{GAP}?\d){{6,11}}
    | 00[1-9]\d{GAP}(?:\(0\){GAP}?)?\d(?:{GAP}?\d){{6,11}}
    | \(0?\d{{2,4}}\){GAP}?\d{{3,5}}(?:{GAP}?\d){{2,6}}
    | 0\d(?:{GAP}\d{{2}}){{4}}
    | 0\d{{2,4}}[ .\-/\u2011]\d{{3,8}}(?:{GAP}\d{{3,4}}){{0,2}}
    | (?:1{GAP})?[2-9]\d{{2}}{GAP}[2-9]\d{{2}}{GAP}\d{{4}}
    | 1?[2-9]\d{{2}}[2-9]\d{{6}}
    )(?![\p{{L}}\p{{N}}_])(?!{GAP}\d)(?!/\d)""",
    regex.X,
)
IDS = regex.compile(
    ESCAPE.join(("(?:", "|")) + r"""(?<![\p{L}\p{N}_+])(?<!\d[.\-/:,])(?<!\-))(?:
      (?P<ssn>\d{3}(?P<s>[\ \u00a0\-\u2010\u2011])\d{2}(?P=s)\d{4})
    | (?P<nino>[A-Z]{2}(?P<t>[\ \u00a0\-\u2010\u2011]?)\d{2}(?P=t)\d{2}(?P=t)\d{2}(?P=t)[A-D])
    | (?P<tax>\d{2}(?P<w>[\ \u00a0])\d{3}(?P=w)\d{3}(?P=w)\d{3})
    | (?P<dni>\d{8}-?[A-Z])
    | (?P<pass>[A-Z]{1,2}\d{7,9})
    | (?P<nine>\d{9})
    | (?P<eleven>\d{11})
    )(?![\p{L}\p{N}_])(?![.\-/:]\d)(?!-[\p{L}])""",
    regex.X,
)
CITY = r"\p{Lu}[\p{L}'’\-]+"
ADDRESS = regex.compile(
    rf"""(?:(?<![\p{{L}}\p{{N}}_./\-\u2013])|{ESCAPE})(?:
      (?:(?:Flat|Apt\.?|Apartment|Unit|Suite|Room)\ \d+[A-Za-z]?,?\ )?\d{{1,5}}[A-Za-z]?\ (?:\p{{Lu}}[\p{{L}}'’\-]*\ ){{1,3}}(?P<en>{STREETS})\b\.?(?!\ \p{{Lu}}[\p{{Ll}}]+\b(?<!\ (?:Apt|Unit|Suite|Flat|Room|North|South|East|West)))
    | \d{{1,5}}[A-Za-z]?(?:\ (?:bis|ter|quater))?,?\ (?:{VOIES})\ (?:(?:de\ la|de\ l['’]|de|du|des|d['’]|la|le|les)\ ?)?\p{{Lu}}[\p{{L}}'’\-]*(?:\ \p{{Lu}}[\p{{L}}'’\-]*)*
    | \p{{Lu}}[\p{{L}}\-]*(?:{STRASSEN})\ \d{{1,4}}[a-z]?
    | \p{{Lu}}[\p{{L}}\-]+\ (?:Straße|Strasse|Str\.|Weg|Gasse|Platz|Allee)\ \d{{1,4}}[a-z]?
    | (?:{LAGEN.replace(" ", chr(92) + " ")})\ (?:\p{{Lu}}[\p{{L}}\-]*\ ){{1,3}}\d{{1,4}}[a-z]?
    | (?:P\.?\ ?O\.?\ ?Box|Post\ Office\ Box|Postfach|Apartado(?:\ de\ Correos)?|BP|Casella\ Postale|Postbus)\ \d[\d\ ]{{0,8}}\d?
    )(?![\p{{L}}\p{{N}}_])""",
    regex.X,
)
WORD = r"\p{Lu}(?:[\p{L}]|['’](?=\p{Lu}))+"
WHOLE = rf"(?:(?:al|el|bin)-)?{WORD}(?:-{WORD})*"
NAME = regex.compile(
    rf"""(?:(?<![\p{{L}}\p{{N}}_@./\\$%\-])(?<!\p{{L}}['’])|{ESCAPE})(?:
      (?P<run>(?:{WHOLE}|\p{{Lu}}\.)(?:[ \u00a0]+(?:(?:{PARTICLES})[ \u00a0]+)*(?:{WHOLE}|\p{{Lu}}\.))+)
    | (?P<turned>{WHOLE},[ ]+(?:{WHOLE}|\p{{Lu}}\.)(?:[ ]+\p{{Lu}}\.)*)
    )(?![\p{{L}}\p{{N}}_(@/]|\.[\p{{L}}\p{{N}}]|-[\p{{L}}])""",
    regex.X,
)
WORDS = regex.compile(r"[^ \u00a0]+")
PARTICLE = regex.compile(PARTICLES)
HAN = regex.compile(rf"(?:(?<![\p{{Han}}\p{{Hiragana}}\p{{Katakana}}\p{{L}}])|{ESCAPE})\p{{Han}}{{1,4}}[ \u3000・]\p{{Han}}{{1,4}}(?![\p{{Han}}\p{{Hiragana}}\p{{Katakana}}\p{{L}}])")
CUT = regex.compile(r"[\p{L}\p{M}]+|\d+|[^\s\p{L}\p{M}\d]")


def _beside(line: str, start: int, end: int) -> list[str]:
    """What stands beside a candidate: two words or signs on each side, the nearest alone, and the last word before
    it. Numbers are written as 0, the ends of a line as ^ and $."""
    before = [_plain(x) for x in CUT.findall(line[max(0, start - 40) : start])]
    left = (["^", "^"] + before)[-2:]
    right = [*[_plain(x) for x in CUT.findall(line[end : end + 40])][:2], "$", "$"][:2]
    word = next((x for x in reversed(before) if x[0].isalpha()), "^")
    return ["L2 " + " ".join(left), "L1 " + left[1], "R2 " + " ".join(right), "R1 " + right[0], "W " + word]


def _plain(token: str) -> str:
    return "0" if token[0].isdigit() else token.lower()


def _mail(line: str) -> Iterator[tuple[int, int]]:
    for m in EMAIL.finditer(line):
        domain = m["d"] or m["e"]
        if not domain or not regex.search(r"\p{L}{2,}$", domain) or regex.fullmatch(r"[\d.\s]+", domain):
            continue
        if line[: m.start()].endswith("://") or regex.match(r":[\p{L}\p{N}~_./\-]*/|:[\p{L}][\p{L}\p{N}_\-]*\.git", line[m.end() :]):
            continue
        yield m.start(), m.end()


def _names(m: regex.Match, given: frozenset[str]) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, first name, family name) of what may be names in a run of capitalised words: what is left when an
    article at its beginning and words that name a number are cut off. A run of more than LONGEST words is cut before
    its listed given names, and what is still longer after every LONGEST words."""
    words = [(m.start() + x.start(), m.start() + x.end(), x[0].rstrip(",")) for x in WORDS.finditer(m[0])]
    if m["turned"] is not None:
        plain = [w for *_, w in words]
        if not any(w in ORGANISATIONS or _label(w) for w in plain):
            yield m.start(), m.end(), plain[1], plain[0]
        return
    if words[0][2] == "The":
        del words[0]
    parts: list[list[tuple[int, int, str]]] = [[]]
    long = sum(w[0].isupper() for *_, w in words) > LONGEST
    for x in words:
        listed, last = x[2].capitalize() in given, parts[-1][-1][2] if parts[-1] else ""
        if _label(x[2]):
            parts.append([])
            continue
        if long and parts[-1] and (listed and last.capitalize() not in given or sum(w[0].isupper() for *_, w in parts[-1]) >= LONGEST):
            parts.append([])
        parts[-1].append(x)
    for part in parts:
        while part and PARTICLE.fullmatch(part[-1][2]):
            part.pop()
        while part and PARTICLE.fullmatch(part[0][2]):
            del part[0]
        if len(part) > 1 and not any(w in ORGANISATIONS for *_, w in part):
            yield part[0][0], part[-1][1], part[0][2], part[-1][2]


def _label(word: str) -> bool:
    return len(word) > 2 and word.lower() in LABELS


def candidates(line: str, given: frozenset[str]) -> list[tuple[int, int, str, bool, list[str]]]:
    """(start, end, kind, protected by form, terms) of one line; candidates don't overlap."""
    out: list[tuple[int, int, str, bool, list[str]]] = []

    taken = bytearray()
    seen = line  # the line with a sign in the place of what a name may stand beside

    def put(start: int, end: int, kind: str, sure: bool, *terms: str) -> None:
        if not taken:
            taken.extend(bytes(len(line)))
        if not any(taken[start:end]):
            taken[start:end] = b"\1" * (end - start)
            out.append((start, end, kind, sure, [*_beside(seen, start, end), *terms]))

    if any(x in line for x in ("@", "%40", "＠", "&")) or ("at" in line or "AT" in line or "At" in line) and WORD_AT.search(line):
        for a, b in _mail(line):
            put(a, b, "email", True, "F sign" if "@" in line[a:b] else "F written")
    digit = DIGIT.search(line)
    if digit and ADDRESS_HINT.search(line):
        for m in ADDRESS.finditer(line):
            put(m.start(), m.end(), "address", True, "F street" if m["en"] else "F other")
    if digit and SIX_DIGITS.search(line):
        for m in IDS.finditer(line):
            form = next(k for k in ("ssn", "nino", "tax", "dni", "pass", "nine", "eleven") if m[k])
            near = [_plain(x) for x in CUT.findall(line[max(0, m.start() - 30) : m.start()])[-6:] + CUT.findall(line[m.end() : m.end() + 30])[:4]]
            own, labelled = form in ("nino", "tax", "dni") or form == "ssn" and m["s"] in "-\u2010\u2011", not LABELS.isdisjoint(near)
            put(m.start(), m.end(), "id_number", own or labelled, *([f"F {form} {labelled}"] if own or labelled else []))
        for m in PHONE.finditer(line):
            n = sum(c.isdigit() for c in m[0])
            if 9 <= n <= 15:
                sure = not m[0].isdigit()
                put(m.start(), m.end(), "phone", sure, *(["F " + regex.sub(r"[^+(0-9]", "-", m[0])[:2].rstrip("123456789")] if sure else []))
    for start, end, kind, sure, _ in out:
        if sure:
            seen = seen[:start] + SIGNS[kind] + " " * (end - start - 2) + SIGNS[kind] + seen[end:]
    for m in NAME.finditer(line) if not line.islower() else ():
        for start, end, first, family in _names(m, given):
            sure = first.capitalize() in given
            put(start, end, "name", sure, *(["G " + first.capitalize()] if sure else []), "S " + family.capitalize())
    for m in HAN.finditer(line) if not line.isascii() else ():
        put(m.start(), m.end(), "name", False)
    return sorted(out)


# ---- corpus ----------------------------------------------------------------------------------------------------


def occurrences(documents: DataFrame, id: str, text: str, given: frozenset[str]) -> DataFrame:
    """(id, version, start, size, kind, sure, text, terms): all candidates of all texts. version is a hash of the
    whole text; start counts code points from 0."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {}
        names = ["id", "version", "start", "size", "kind", "sure", "text", "terms"]
        for b in batches:
            rows: list[list] = [[] for _ in names]
            for i in range(b.num_rows):
                whole, at = b.column(2)[i].as_py(), 0
                for line in whole.split("\n"):
                    found = known.get(line)
                    if found is None:
                        found = candidates(line, given)
                        if len(line) <= 256:
                            if len(known) >= LINES_KEPT:
                                known.clear()
                            known[line] = found
                    for start, end, kind, sure, terms in found:
                        for column, x in zip(rows, (i, i, at + start, end - start, kind, sure, line[start:end], terms), strict=True):
                            column.append(x)
                    at += len(line) + 1
            which = pa.array(rows[0], pa.int64())
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(which), b.column(1).take(which), *(pa.array(x, k) for x, k in zip(rows[2:], kinds, strict=True))], names)

    kind = documents.schema[id].dataType.simpleString()
    rows = documents.where(F.length(text) > 0).select(F.col(id).alias("id"), F.xxhash64(text).alias("version"), F.col(text).alias("text"))
    return rows.mapInArrow(find, f"id {kind}, version long, start int, size int, kind string, sure boolean, text string, terms array<string>")


def _all_salts() -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))


def disclosure(found: DataFrame) -> DataFrame:
    """(kind, term, n, p): for each term the different candidates that it occurs with, and how many of them are
    protected by form. Both aggregations combine before they shuffle."""
    pairs = found.select("kind", "text", "sure", F.explode("terms").alias("term"))
    pairs = pairs.groupBy("kind", "term", "text").agg(F.max("sure").alias("sure"))
    return pairs.groupBy("kind", "term").agg(F.count(F.lit(1)).alias("n"), F.count_if("sure").alias("p"))


def bits(n: Column, p: Column, role: Column) -> Column:
    """Pointwise mutual information, with SUPPORT candidates at the prior of the term's role added; null for too few
    candidates, which for a form or a listed name none are."""
    k, known = float(SUPPORT + 1), role.isin("F", "G")
    before = F.when(role == "F", F.lit(FORM_PRIOR)).when(role == "G", F.lit(GIVEN_PRIOR)).otherwise(F.lit(PRIOR))
    return F.when(known | (n >= SUPPORT), F.log2((p + before * k) / (n + k) / PRIOR))


def weighed(found: DataFrame) -> DataFrame:
    """(sign, kind, sure, left, right, given, family, form, cased, exact): the bits of each different candidate with its
    terms, by role; copies are weighed once."""
    asked = found.groupBy("sign").agg(*[F.first(c).alias(c) for c in ("kind", "text", "sure", "terms")])
    known = disclosure(found).withColumn("salt", _all_salts())
    terms = asked.select("sign", "kind", "sure", F.explode("terms").alias("term"), F.pmod("sign", F.lit(SALTS)).cast("int").alias("salt"))
    own, role = F.col("sure").cast("int"), F.split("term", " ")[0]  # a candidate isn't evidence for itself
    said = terms.join(known, ["kind", "term", "salt"]).select("sign", "kind", "sure", role.alias("role"), bits(F.col("n") - 1, F.col("p") - own, role).alias("b"))
    part = lambda r: F.max(F.when(F.col("role") == r, F.col("b")))
    near = lambda side: F.coalesce(part(side + "2"), part(side + "1"), F.lit(0.0))
    zero = lambda r: F.coalesce(part(r), F.lit(0.0))
    return said.groupBy("sign", "kind", "sure").agg(
        near("L").alias("left"), near("R").alias("right"), zero("G").alias("given"), zero("S").alias("family"), zero("F").alias("form"),
        F.max((F.col("role") == "S").cast("int")).alias("cased"),
        (zero("L2") + zero("R2") + zero("W")).alias("exact"),  # a bare number has nothing of its own: two words must agree
    )


def protected(found: DataFrame) -> DataFrame:
    """The candidates that are personal data: those whose terms disclose enough."""
    found = written(found.withColumn("sign", F.xxhash64("kind", "text", F.array_join("terms", "\x01"))))
    beside = F.col("left") + F.col("right")
    is_name = (beside + F.col("given") + F.col("family") >= NAME_BITS) & (F.greatest("right", "family") >= NAME_KEY_BITS)
    passed = F.when(F.col("kind") == "name", F.when(F.col("cased") == 1, is_name).otherwise(beside >= OTHER_BITS))
    passed = passed.when(F.col("sure"), F.col("form") + beside >= OTHER_BITS).otherwise(F.col("exact") >= OTHER_BITS)
    # what follows is a join on a sign that a third of all rows may have, so both sides are spread
    good = weighed(found).where(passed).select("sign", _all_salts().alias("salt"))
    kept = found.withColumn("salt", F.pmod(F.hash("id", "start"), F.lit(SALTS)).cast("int")).join(good, ["sign", "salt"], "left_semi")
    return kept.select("id", "version", "start", "size", "kind")


def find_personal(documents: DataFrame, id: str, text: str, given: frozenset[str]) -> DataFrame:
    """(id, start_pos, kind) of every occurrence. Null and empty texts have none; repeated rows, the same in id and
    text, count once. given are listed given names, a small fixed table."""
    return protected(occurrences(documents, id, text, given)).distinct().select(F.col("id").alias(id), F.col("start").alias("start_pos"), "kind")


def redact(documents: DataFrame, id: str, text: str, given: frozenset[str]) -> DataFrame:
    """(id, text) of every row, with a typed placeholder in the place of each occurrence. Null stays null."""
    spans = protected(occurrences(documents, id, text, given)).distinct().groupBy("id", "version").agg(F.sort_array(F.collect_list(F.struct("start", "size", "kind"))).alias("spans"))
    rows = documents.select(F.col(id).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("version"))
    near = F.col("d.id").eqNullSafe(F.col("s.id")) & (F.col("d.version") == F.col("s.version"))
    marks = F.create_map(*[F.lit(x) for kv in PLACEHOLDERS.items() for x in kv])
    step = lambda a, x: F.struct(
        F.concat(a["out"], F.col("text").substr(a["at"] + 1, x["start"] - a["at"]), marks[x["kind"]]).alias("out"), (x["start"] + x["size"]).alias("at")
    )
    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    done = F.aggregate("spans", begin, step, lambda a: F.concat(a["out"], F.col("text").substr(a["at"] + 1, F.length("text"))))
    joined = rows.alias("d").join(spans.alias("s"), near, "left").select(F.col("d.id").alias("id"), F.col("d.text").alias("text"), "s.spans")
    return joined.select(F.col("id").alias(id), F.when(F.col("spans").isNull(), F.col("text")).otherwise(done).alias(text))
