"""Licence scans by sentence rules.

A text is cut into fragments at line ends and after sentence marks, and a
fragment is normalised to its lower-case words.  A known sentence is one
fragment, or several in a row when lines are wrapped; a table from normalised
sentences to identifiers names it, longest first.  The identifiers of a
text, in order, are then matched against ordered rules: at each place the
first rule whose sequence fits gives a licence and takes its sentences.  Some
sentences hold a name of up to ``SLOT_WORDS`` words.
Fragments that speak of licensing but are no known sentence are reported as
unknown.  One that sets a condition of its own (``CONDITION``) inside or right
after a rule's sentences makes the licence another one: the rule does not fit,
so a stricter text is never reported as the plain licence.

Only texts with one of the trigger words reach the matcher; every known
sentence holds one (checked when the table is built).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import arrow_map
from revlens.llm.licence_texts import RULES, SENTENCES, SLOTS

TRIGGER = (r"(?i)licen[cs]e|redistribut|warrant|permission|permitted|copyright[\W_]+holder|"
           r"public[\W_]+domain|free[\W_]+software|\bmpl\b")
UNKNOWN = "UNKNOWN"
CONDITION = "UNKNOWN_CONDITION"
SLOT_WORDS = 24         # the longest name that a sentence takes

_FRAGMENT = re.compile(r"[^\n]*?(?:[.!?;:]+(?=\s)|(?=\n)|$)\s*")
_WORDS = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
_CONDITION = re.compile(r"\bneither the names?\b|\bendorse or promote\b|\badvertising materials\b|"
                        r"\bmay not be used\b|\bmust display\b")
_LICENSING = re.compile(r"\b(?:licen[cs]ed?|released) under\b|\blicen[cs]e\b")


def normalise(text: str) -> tuple[str, ...]:
    return tuple(_WORDS.findall(text.lower()))


def _table(sentences: dict[str, str]) -> dict[tuple[str, ...], str]:
    for name, text in sentences.items():
        if not re.search(TRIGGER, text):
            raise ValueError(f"no trigger word in {name}")
    return {normalise(text): name for name, text in sentences.items()}


def _starts(table: dict[tuple[str, ...], str], slots=SLOTS) -> set[str]:
    return {words[0] for words in table} | {normalise(head)[0] for _, head, _ in slots}


def _slotted(words: tuple[str, ...], slots: list[tuple]) -> str | None:
    for name, head, tail in slots:
        if words[:len(head)] == head and words[-len(tail):] == tail \
                and 0 < len(words) - len(head) - len(tail) <= SLOT_WORDS:
            return name
    return None


def identify(text: str, table: dict[tuple[str, ...], str], starts: set[str],
             slots=SLOTS) -> list[tuple[str, int, int]]:
    """Known sentences in order: (identifier, start, end) in code points.
    Known ones have the longest reading from their first fragment; a list mark
    of one or two characters before them is left out."""
    pieces = [(m.start(), m.end()) for m in _FRAGMENT.finditer(text) if m.end() > m.start()]
    fragments = [(a, b, words) for a, b in pieces if (words := normalise(text[a:b]))]
    parted = [(name, normalise(head), normalise(tail)) for name, head, tail in slots]
    longest = max([*map(len, table), *(len(h) + len(t) + SLOT_WORDS for _, h, t in parted)], default=0)
    out, i = [], 0
    while i < len(fragments):
        a, _, words = fragments[i]
        marked = len(words) > 1 and len(words[0]) <= 2 and words[0] not in starts
        found, joined = 0, ()
        if words[marked] in starts:
            for j in range(i, len(fragments)):
                joined += fragments[j][2][marked:] if j == i else fragments[j][2]
                if len(joined) > longest:
                    break
                known = table.get(joined) or _slotted(joined, parted)
                if known:
                    found, name = j + 1, known
        if found:
            out.append((name, a, a + len(text[a:fragments[found - 1][1]].rstrip())))
            i = found
            continue
        said = " ".join(words)
        unknown = CONDITION if _CONDITION.search(said) else UNKNOWN if _LICENSING.search(said) else None
        if unknown:
            out.append((unknown, a, a + len(text[a:fragments[i][1]].rstrip())))
        i += 1
    return out


def match_rules(names: list[str], rules=RULES) -> list[tuple[str, int, int]]:
    """Licences in order: (licence, first, after last sentence)."""
    out, i = [], 0
    while i < len(names):
        for licence, sequence in rules:
            at = i
            for wanted in sequence:
                optional = wanted.startswith("[")
                if at < len(names) and names[at] == wanted.strip("[]"):
                    at += 1
                elif not optional:
                    break
            else:
                if at < len(names) and names[at] == CONDITION:
                    continue
                out.append((licence, i, at))
                i = at
                break
        else:
            i += 1
    return out


_RESULT = pa.struct([("licence", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         sentences: dict[str, str] = SENTENCES, rules=RULES, slots=SLOTS) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``sentences`` (identifiers in
    order, ``UNKNOWN`` and ``CONDITION`` among them) and ``licences``, an array of
    struct(licence, start, end) in code points of the text.

    Null and empty texts have none of either.  Repeated rows each give a row;
    other columns are ignored; an empty table gives an empty result."""
    table = _table(sentences)
    starts = _starts(table, slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, licences = [], []
            for text in batch.column("text").to_pylist():
                found = identify(text, table, starts, slots) if text else []
                ids = [name for name, _, _ in found]
                names.append(ids)
                licences.append([{"licence": licence, "start": found[a][1], "end": found[b - 1][2]}
                                 for licence, a, b in match_rules(ids, rules)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(names, pa.list_(pa.string())),
                 pa.array(licences, pa.list_(_RESULT))], names=["id", "sentences", "licences"])

    text = F.col(text_col).cast("string")
    some = docs.select(F.col(id_col).alias("id"),
                       F.when(text.rlike(TRIGGER), text).alias("text"))
    id_type = some.schema["id"].dataType.simpleString()
    return arrow_map(some, run, f"id {id_type}, sentences array<string>, "
                                "licences array<struct<licence:string,start:long,end:long>>")
