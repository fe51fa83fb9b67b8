"""License scans: ordered signature rules behind a keyword gate, with containment suppression.

A text becomes its words, joined by single spaces. Only the rules whose keyword occurs are tried. Detections
are taken by priority, then length, then place; one that lies inside a taken detection is suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import cache

from pyspark.sql import DataFrame

from tessella.llm.common import alnum_words, map_rows

# label | keyword that gates the rules | name, as a pattern over lower-case words | SPDX identifiers' words
FAMILIES = """
mit | mit | mit(?: x11)? | mit|mit 0
expat | expat | expat | expat
x11 | x11 | x11 | x11
isc | isc | isc | isc
apache | apache | apache(?: software)?(?: foundation)? | apache 1 [01]|apache 2 0
bsd | bsd | (?:(?:new|modified|revised|simplified|original|[234] clause) )?bsd(?: [0234] clause)? | 0bsd|bsd [1234] clause(?: \\S+)?
gpl | general | (?:gnu )?general public | (?:gpl [123] 0(?: only| or later)?)
gpl | gpl | (?:gnu )?gpl ?v?[123]?(?: 0)? | gpl [123] 0(?: only| or later)?
gpl | gplv2 | gplv2 | gplv2
gpl | gplv3 | gplv3 | gplv3
lgpl | lesser | (?:gnu )?lesser general public | lgpl [23] [01](?: only| or later)?
lgpl | library | (?:gnu )?library general public | lgpl 2 0(?: only| or later)?
lgpl | lgpl | (?:gnu )?lgpl ?v?[23]?(?: [01])? | lgpl [23] [01](?: only| or later)?
agpl | affero | (?:gnu )?affero general public | agpl [13] 0(?: only| or later)?
agpl | agpl | (?:gnu )?agpl ?v?[13]?(?: 0)? | agpl [13] 0(?: only| or later)?
gfdl | documentation | (?:gnu )?free documentation | gfdl 1 [123](?: only| or later)?
fsfap | permissive | (?:gnu )?all permissive | fsfap
mpl | mozilla | mozilla public | mpl [12] [01]
mpl | mpl | mpl [12] [01] | mpl [12] [01](?: no copyleft exception)?
epl | eclipse | eclipse public | epl [12] 0
epl | epl | epl [12] 0 | epl [12] 0
edl | distribution | eclipse distribution | bsd 3 clause
cpl | common | common public | cpl 1 0
cpal | attribution | common public attribution | cpal 1 0
cddl | cddl | cddl(?: 1 [01])? | cddl 1 [01]
cddl | development | common development and distribution | cddl 1 [01]
ipl | ibm | ibm public | ipl 1 0
spl | sun | sun public | spl 1 0
sissl | industry | sun industry standards source | sissl(?: 1 2)?
apsl | apple | apple public source | apsl [12] [012]
asl | sample | apple sample code | aml
bsl | boost | boost software | bsl 1 0
busl | business | business source | busl 1 1
sspl | server | server side public | sspl 1 0
elastic | elastic | elastic | elastic 2 0
commons_clause | clause | commons clause | commons clause
zlib | zlib | zlib(?: libpng)? | zlib(?: acknowledgement)?
libpng | libpng | (?:png reference library|libpng) | libpng(?: 2 0)?
libtiff | libtiff | libtiff | libtiff
openssl | openssl | openssl | openssl
ssleay | ssleay | (?:original )?ssleay | ssleay
curl | curl | curl | curl
ntp | ntp | ntp | ntp
postgresql | postgresql | postgresql | postgresql
python | python | python(?: software foundation)? | python 2 0|psf 2 0
cnri | cnri | cnri(?: open source)?(?: python)? | cnri python
php | php | php | php 3 0(?:1)?
zend | zend | zend(?: engine)? | zend 2 0
ruby | ruby | ruby | ruby
artistic | artistic | (?:clarified )?artistic | artistic [12] 0(?: perl| cl8)?
perl | perl | perl | artistic 1 0 perl
tcl | tcl | tcl(?: tk)? | tcl
vim | vim | vim | vim
w3c | w3c | w3c(?: software)?(?: notice)?(?: and)? | w3c(?: 19980720| 20150513)?
unicode | unicode | unicode(?: data files and software)? | unicode dfs 201[56]|unicode 3 0
icu | icu | icu | icu
ijg | jpeg | independent jpeg group | ijg
freetype | freetype | freetype(?: project)? | ftl
imagemagick | imagemagick | imagemagick | imagemagick
ofl | ofl | (?:sil )?ofl(?: 1 [01])? | ofl 1 [01](?: rfn| no rfn)?
ofl | font | (?:sil )?open font | ofl 1 [01](?: rfn| no rfn)?
ubuntu_font | ubuntu | ubuntu font(?: licence)? | ubuntu font licence 1 0
wtfpl | wtfpl | wtfpl | wtfpl
unlicense | unlicense | unlicense | unlicense
beerware | beer | beer ?ware | beerware
beerware | beerware | beerware | beerware
cc0 | cc0 | cc0(?: 1 0)?(?: universal)? | cc0 1 0
cc_by | cc | cc by(?: [1234] [05])? | cc by [1234] [05]
cc_by | attribution | creative commons attribution(?: [1234] [05])?(?: international)? | cc by [1234] [05]
cc_by_sa | cc | cc by sa(?: [1234] [05])? | cc by sa [1234] [05]
cc_by_sa | sharealike | creative commons attribution share ?alike | cc by sa [1234] [05]
cc_by_nc | cc | cc by nc(?: [1234] [05])? | cc by nc(?: nd| sa)? [1234] [05]
cc_by_nc | noncommercial | creative commons attribution non ?commercial | cc by nc [1234] [05]
cc_by_nd | cc | cc by nd(?: [1234] [05])? | cc by nd [1234] [05]
cc_by_nd | noderivatives | creative commons attribution no ?deriv(?:ative)?s | cc by nd [1234] [05]
odbl | odbl | odbl(?: 1 0)? | odbl 1 0
odbl | database | open database | odbl 1 0
pddl | pddl | pddl(?: 1 0)? | pddl 1 0
odc_by | commons | open data commons attribution | odc by 1 0
cdla | cdla | cdla | cdla (?:permissive|sharing) [12] 0
eupl | eupl | eupl(?: v?1 [012])? | eupl 1 [012]
eupl | european | european union public | eupl 1 [012]
cecill | cecill | cecill(?: [bc])?(?: v?[12](?: [01])?)? | cecill (?:1 [01]|2 [01]|b|c)
mulan | mulan | mulan (?:permissive software|psl)(?: v[12])? | mulanpsl [12] 0
osl | osl | osl(?: [123] [01])? | osl [123] [01]
osl | open | open software | osl [123] [01]
afl | academic | academic free | afl [123] [012]
ecl | educational | educational community | ecl [12] 0
ncsa | ncsa | (?:university of illinois )?ncsa(?: open source)? | ncsa
naist | naist | naist | naist 2003
upl | universal | universal permissive | upl 1 0
ms_pl | microsoft | microsoft public | ms pl
ms_rl | reciprocal | microsoft reciprocal | ms rl
rpl | reciprocal | (?<!microsoft )reciprocal public | rpl 1 [15]
qpl | qpl | qpl | qpl 1 0
qpl | q | q public | qpl 1 0
sleepycat | sleepycat | sleepycat | sleepycat
intel | intel | intel(?: simplified)?(?: open source)? | intel
nokia | nokia | nokia open source | nokia
motosoto | motosoto | motosoto(?: open source)? | motosoto
bittorrent | bittorrent | bittorrent(?: open source)? | bittorrent 1 [01]
json | json | json | json
hpnd | historical | historical permission notice and disclaimer | hpnd(?: \\S+)?
blueoak | oak | blue oak model | blueoak 1 0 0
openrail | openrail | (?:creativeml |bigscience )?(?:bloom )?open ?rail(?: [ms]){0,2} | openrail
llama | llama | llama [23](?: [123])?(?: community)? | llama[23](?: [123])?
"""

# label | keyword | sentence of the license's own text | strength
SENTENCES = """
mit | granted | permission is hereby granted free of charge to any person obtaining a copy of this software | 0.95
mit | software | the software is provided as is without warranty of any kind express or implied | 0.6
isc | granted | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted | 0.95
bsd | redistribution | redistribution and use in source and binary forms with or without modification are permitted | 0.9
bsd | endorse | neither the name of (?:\\S+ ){1,40}?nor the names of its contributors may be used to endorse or promote | 0.95
apache | apache | you may not use this file except in compliance with the license | 0.8
apache | apache | www apache org licenses license 2 0 | 0.95
gpl | redistribute | you can redistribute it and or modify it under the terms of the gnu general public license | 0.95
gpl | gnu | www gnu org licenses gpl(?: [123] 0)? | 0.9
lgpl | redistribute | you can redistribute it and or modify it under the terms of the gnu lesser general public license | 0.95
lgpl | gnu | www gnu org licenses lgpl(?: [23] [01])? | 0.9
agpl | redistribute | you can redistribute it and or modify it under the terms of the gnu affero general public license | 0.95
agpl | gnu | www gnu org licenses agpl(?: 3 0)? | 0.9
gfdl | gnu | www gnu org licenses fdl(?: 1 [123])? | 0.9
mpl | mozilla | this source code form is subject to the terms of the mozilla public license | 0.95
mpl | mozilla | mozilla org mpl [12](?: [01])? | 0.9
epl | eclipse | www eclipse org legal epl(?: v[12]0| 2 0)? | 0.9
bsl | boost | www boost org license 1 0 txt | 0.95
zlib | warranty | this software is provided as is without any express or implied warranty in no event will the authors be held liable | 0.9
unlicense | domain | this is free and unencumbered software released into the public domain | 0.95
public_domain | domain | (?:released|placed|dedicated|put) (?:in|into|to) the public domain | 0.7
public_domain | domain | no rights reserved | 0.5
wtfpl | fuck | do what the fuck you want to public license | 0.95
beerware | beer | you can buy me a beer in return | 0.9
cc0 | creativecommons | creativecommons org publicdomain zero 1 0 | 0.95
cc_by | creativecommons | creativecommons org licenses by [1234] [05] | 0.95
cc_by_sa | creativecommons | creativecommons org licenses by sa [1234] [05] | 0.95
cc_by_nc | creativecommons | creativecommons org licenses by nc(?: nd| sa)? [1234] [05] | 0.95
cc_by_nd | creativecommons | creativecommons org licenses by nd [1234] [05] | 0.95
ofl | openfontlicense | openfontlicense org | 0.8
opensource | opensource | opensource org licenses [a-z0-9]+ | 0.5
proprietary | reserved | all rights reserved | 0.3
proprietary | confidential | proprietary and confidential | 0.6
proprietary | permission | without (?:the )?(?:prior|express) written (?:permission|consent) | 0.4
"""

_LICENSE = "licen[cs]es?"
_GRANT = (
    "(?:licensed|released|distributed|available|published|provided|covered|redistributed|used|shared)"
    "(?: \\S+){0,2}? (?:under|by|with|via|pursuant to)(?: the)?(?: terms(?: and conditions)? of)?(?: the| an?)? "
)
_VERSION = "(?:(?: version| v)? ?\\d(?: \\d){0,2}(?: (?:only|or later))?)?"

# First phrases of the contract of the query; their labels are always kept.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


@cache
def rules() -> dict[bytes, list[tuple[int, str, float, re.Pattern]]]:
    """Rules by keyword: (priority, label, strength, pattern). Lower priority numbers come first."""
    table: dict[bytes, list] = {}

    def add(priority: int, label: str, keyword: str, strength: float, pattern: str) -> None:
        # The last word of a match is looked at, not taken: neighbours share their space.
        compiled = re.compile(f"(?<= )(?:{pattern})(?= )".encode())
        table.setdefault(keyword.encode(), []).append((priority, label, strength, compiled))

    split = lambda text: ([p.strip(" ") for p in re.split(r" \| ", line)] for line in text.strip().splitlines())
    for label, keyword, name, _ in split(FAMILIES):
        add(2, label, keyword, 0.9, f"{_GRANT}(?:{name})(?: (?:public )?{_LICENSE})?{_VERSION}")
        add(3, label, keyword, 0.7, f"(?:{name})(?: (?:style|public|free|open source))? {_LICENSE}{_VERSION}")
    for label, keyword, sentence, strength in split(SENTENCES):
        add(1, label, keyword, float(strength), sentence)
    return table


# Of an SPDX expression: its head, what joins two identifiers, and an exception or an identifier without a label.
_HEAD = re.compile(b"(?<= )spdx license identifier ")
_JOIN = " (?:or(?! later )|and|with) "
_JOINT = re.compile(_JOIN.encode())
_UNKNOWN = re.compile(rf"\S+(?:(?!{_JOIN}) \S+){{0,7}}(?={_JOIN})".encode())


@cache
def identifiers() -> list[tuple[str, re.Pattern]]:
    """Labels and patterns of SPDX identifiers; one that the expression goes on after is preferred."""
    lines = (re.split(r" \| ", line, maxsplit=3) for line in FAMILIES.strip().splitlines())
    either = lambda names: f"(?:{names})(?={_JOIN})|(?:{names})(?= )"
    return [(label.strip(), re.compile(either(names.strip()).encode())) for label, _, _, names in lines]


def spdx_places(text: bytes) -> list[tuple[int, int, str]]:
    """(start, end, label) of every identifier of SPDX expressions; the first one includes the head."""
    found = []
    for head in _HEAD.finditer(text):
        start, at = head.start(), head.end()
        while True:
            known = [(m.end(), label) for label, pattern in identifiers() if (m := pattern.match(text, at))]
            if known:
                end = max(known)[0]
                found += sorted({(start, end, label) for stop, label in known if stop == end})
            elif other := _UNKNOWN.match(text, at):
                end = other.end()
            else:
                break
            joint = _JOINT.match(text, end)
            if not joint:
                break
            start = at = joint.end()
    return found


def detect(words: list[bytes]) -> list[tuple[str, int, int, float]]:
    """Kept detections ``(label, first word, last word, strength)`` of a text, by place."""
    table = rules()
    present = table.keys() & words if len(words) < 64 else set(filter(table.__contains__, words))
    spdx = b"spdx" in words
    if not present and not spdx:
        return []
    text = b" " + b" ".join(words) + b" "
    found = [(0, start - end, start, end, label, 1.0) for start, end, label in spdx_places(text)] if spdx else []
    for keyword in present:
        for priority, label, strength, pattern in table[keyword]:
            found += [(priority, m.start() - m.end(), m.start(), m.end(), label, strength) for m in pattern.finditer(text)]
    taken, cover = [], []  # cover: the taken ranges that lie in no other taken one, so starts and ends rise
    for _, _, start, end, label, strength in sorted(found):
        at = bisect_right(cover, (start, len(text) + 1))
        if at and cover[at - 1][1] >= end:
            continue
        taken.append((start, end, label, strength))
        last = at
        while last < len(cover) and cover[last][1] <= end:
            last += 1
        cover[at:last] = [(start, end)]
    out, at, word = [], 0, -1
    for start, end, label, strength in sorted(taken):
        word += text.count(b" ", at, start)
        at = start
        out.append((label, word, word + text.count(b" ", start, end), strength))
    return out


def phrase_places(words: list[bytes], phrases: dict[str, str]) -> list[tuple[int, str]]:
    """All places (first word, label) where the words of a phrase stand consecutively."""
    text, places = b" " + b" ".join(words) + b" ", []
    for phrase, label in phrases.items():
        needle = b" " + phrase.encode() + b" "
        at, seen, word = text.find(needle), 0, 0
        while at >= 0:
            word += text.count(b" ", seen, at)
            places.append((word, label))
            seen, at = at, text.find(needle, at + 1)
    return sorted(places)


SCAN = (
    "n_words long, places array<struct<word:long,label:string>>, "
    "detections array<struct<label:string,first:long,last:long,strength:double>>"
)


def scan_licenses(documents: DataFrame, *, text: str = "text", phrases: dict[str, str] | None = None) -> DataFrame:
    """Add ``n_words``, ``places`` of the plain phrases and the ``detections`` left after suppression.

    Row by row, so nothing is shuffled and repeated rows get equal results. Null and empty texts have no
    words, places or detections; ties between rules fall to the longer, then the earlier, then the label.
    Columns of the documents are kept; those named like a result, in any case, are replaced.
    """
    phrases = BASE_PHRASES if phrases is None else phrases
    words_needed = {p.split()[0].encode() for p in phrases}
    kept = [c for c in documents.columns if c.lower() not in ("n_words", "places", "detections")]
    types = "".join(f"`{c}` {documents.schema[c].dataType.simpleString()}, " for c in kept)

    def rows(columns: dict[str, list]):
        for i, value in enumerate(columns[text]):
            words = alnum_words(value)
            places = [] if words_needed.isdisjoint(words) else phrase_places(words, phrases)
            yield (
                *(columns[c][i] for c in kept),
                len(words),
                [{"word": w, "label": label} for w, label in places],
                [dict(zip(("label", "first", "last", "strength"), d, strict=True)) for d in detect(words)],
            )

    return map_rows(documents.select(*kept), types + SCAN, rows)
