"""License scans: ordered signature rules behind a keyword prefilter, overlaps resolved by priority and containment."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# The base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Words that every signature needs at least one of; texts without any are not scanned by signature.
KEYWORDS = (
    b"licen", b"copyright", b"copying", b"warrant", b"public domain", b"redistribut", b"spdx", b"cc by", b"cc0", b"unlicense", b"all rights reserved", b"permission is hereby granted", b"permission to use",
    b"released under", b"distributed under", b"available under", b"published under",
)
# Licences as name, expression of its words, versions ('' for none).
NAMES = (
    ("mit", "mit|expat", ("",)), ("apache", "apache(?: software)?", ("", "1 0", "1 1", "2 0")), ("gpl", "gnu general public|general public|gnu gpl|gpl", ("", "1", "2", "3")),
    ("lgpl", "gnu (?:lesser|library) general public|lgpl", ("", "2 1", "3")), ("agpl", "gnu affero general public|affero general public|agpl", ("", "3")),
    ("bsd", "bsd|new bsd|modified bsd|[234] clause bsd", ("", "2 clause", "3 clause", "4 clause")), ("mpl", "mozilla public|mpl", ("", "1 1", "2 0")),
    ("epl", "eclipse public|epl", ("", "1 0", "2 0")), ("cddl", "common development and distribution|cddl", ("", "1 0", "1 1")),
    ("isc", "isc", ("",)), ("zlib", "zlib(?: libpng)?", ("",)), ("artistic", "(?:perl )?artistic", ("", "1 0", "2 0")),
    ("unlicense", "the unlicense|unlicense", ("",)), ("boost", "boost software|bsl", ("", "1 0")), ("wtfpl", "do what the fuck you want to public|wtfpl", ("", "2")),
    ("eupl", "european union public|eupl", ("", "1 1", "1 2")), ("ofl", "sil open font|open font|ofl", ("", "1 0", "1 1")), ("psf", "python software foundation|psf", ("", "2")),
    ("cc-by", "creative commons attribution|cc by", ("", "2 0", "2 5", "3 0", "4 0")), ("cc-by-sa", "creative commons attribution share ?alike|cc by sa", ("", "2 0", "3 0", "4 0")),
    ("cc-by-nc", "creative commons attribution non ?commercial|cc by nc", ("", "2 0", "3 0", "4 0")), ("cc-by-nd", "creative commons attribution no ?deriv(?:ative)?s?|cc by nd", ("", "3 0", "4 0")),
    ("cc-by-nc-sa", "creative commons attribution non ?commercial share ?alike|cc by nc sa", ("", "3 0", "4 0")), ("cc0", "creative commons zero|cc0", ("", "1 0")),
    ("odbl", "open database|odbl", ("", "1 0")), ("gfdl", "gnu free documentation|gfdl", ("", "1 2", "1 3")), ("ms-pl", "microsoft public|ms pl", ("",)), ("cecill", "cecill", ("", "2 1")),
)
# Forms that a licence is named in: expression around NAME and VERSION, priority (higher wins), confidence, words of which
# it needs one.
FORMS = (
    (r"spdx licen[sc]e identifier (?:NAME)(?: VERSION)(?: only| or later)?", 60, 1.0, ("spdx",)), (r"(?:released|licen[sc]ed|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?(?:NAME)(?: licen[sc]e)?(?: version| v)?(?: VERSION)", 50, 0.95, ("under",)),
    (r"licen[sc]e (?:NAME)(?: version| v)?(?: VERSION)", 30, 0.8, ("license", "licence")), (r"(?:NAME) licen[sc]e(?: version| v)?(?: VERSION)", 40, 0.9, ("license", "licence")),
)
# Signatures of their own: label, expression, priority, confidence, a word that it needs.
TEXTS = (
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", 70, 1.0, "permission"), ("bsd", r"redistribution and use in source and binary forms with or without modification", 70, 1.0, "redistribution"),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose", 70, 1.0, "permission"), ("public-domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain", 50, 0.9, "domain"),
    ("copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}", 10, 0.4, "copyright"), ("proprietary", r"all rights reserved", 20, 0.5, "reserved"),
    ("unknown", r"licen[sc]ed under", 5, 0.3, "under"), ("no-warranty", r"without warranty of any kind|without any warranty", 15, 0.4, "warranty"),
)


def _tells(name: str) -> tuple[bytes, ...]:
    """Of each alternative of a name the longest word that it always has."""
    sure = re.sub(r"\(\?:[^)]*\)\??|\[[^]]*\]|[a-z0-9]* \?[a-z0-9]*", " ", name)
    return tuple(max(x.split(), key=len).encode() for x in sure.split("|"))


def rules() -> list[tuple[re.Pattern, str, int, float, tuple[tuple[bytes, ...], ...]]]:
    """The signatures in order: compiled expression over words joined by blanks, label, priority, confidence, and what it
    needs: of each of these groups of words one.

    A form without a version is of lower priority than with one, as it tells less.
    """
    made = [(label, text, priority, trust, ((word.encode(),),)) for label, text, priority, trust, word in TEXTS]
    for label, name, versions in NAMES:
        for version in versions:
            for form, priority, trust, told in FORMS:
                own = form.replace("NAME", name).replace("(?: VERSION)", f" {version}" if version else "")
                needs = (tuple(w.encode() for w in told), _tells(name), *((w.encode(),) for w in version.split()))
                made.append((f"{label}-{version.replace(' ', '.')}" if version else label, own, priority + 5 * bool(version), trust, needs))
    return [(re.compile(rb"(?<![^ ])(?:" + text.encode() + rb")(?![^ ])"), label, priority, trust, needs) for label, text, priority, trust, needs in sorted(made, key=lambda r: (-r[2], r[0], r[1]))]


#: Other bytes than digits, letters and those of characters beyond ASCII part words.
_TO_WORDS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def scan(text: str, signatures: list) -> tuple:
    """n_words, n_base, first_word, last_word, base labels, labels and score of one text."""
    words = text.encode("utf-8", "surrogatepass").lower().translate(_TO_WORDS).split()
    joined = b" " + b" ".join(words) + b" "
    if not any(k in joined for k in KEYWORDS):
        return len(words), 0, None, None, "", "", 0.0
    said = set(words)
    starts = 1 + np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])])  # of words in joined
    places, base = [], set()
    for phrase, label in BASE:
        at = joined.find(needle := b" " + phrase.encode() + b" ")
        while at >= 0:
            places.append(at + 1)
            base.add(label)
            at = joined.find(needle, at + 1)
    first, last = (int(np.searchsorted(starts, x)) for x in (min(places), max(places))) if places else (None, None)
    kinds, doubt = set(), 1.0
    reach = np.zeros(len(starts), np.int64)  # by word: how far a detection goes that starts there or before
    for pattern, label, _, trust, needs in signatures:  # by falling priority
        if all(any(w in said for w in group) for group in needs):
            found = np.array([m.span() for m in pattern.finditer(joined, 1)], np.int64).reshape(-1, 2)
            at = np.searchsorted(starts, found[:, 0])
            stays = reach[at] < found[:, 1]  # what lies inside a detection of higher priority goes
            if stays.any():
                kinds.add(label)
                doubt *= (1 - trust) ** int(stays.sum())
                np.maximum.at(reach, at[stays], found[stays, 1])
                reach = np.maximum.accumulate(reach)
    score = 1.0 if base else round(1 - doubt, 6)
    return len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(base | kinds)), score


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """License labels of every text; a row for each row of docs.

    Words are runs of digits, letters (A-Z lower-cased) and characters beyond ASCII. base_labels come from the BASE
    phrases; labels add the signatures' of which no part lies wholly inside a detection of higher priority. score is 1
    with a base phrase, else the chance that some detection is right, taking them as independent. A null or empty text
    has no words, no labels (empty strings) and score 0. Repeated rows are scanned one by one and alike; an empty table gives
    no rows; columns besides doc_id and text are not read.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signatures = rules()
        for batch in it:
            rows = [scan(t or "", signatures) for t in batch.column(1).to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = (pa.int64(),) * 4 + (pa.string(),) * 2 + (pa.float64(),)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(batches, SCHEMA)
