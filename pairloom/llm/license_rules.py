"""Signature rules for licenses, over text reduced to lower-case words and single spaces.

A rule is a pattern of words with keywords, one of which starts a word in every text it matches. Names of
licenses are written by hand and combined with the ways in which texts refer to them;
signatures of license texts are written by hand throughout.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    #: Java pattern of words; it is matched from one space to the next.
    pattern: str
    #: Words of which the text must contain one, from the start of a word, for the pattern
    #: to be tried; parted by "|".
    keyword: str
    #: Of detections where one contains the other, the higher priority stays.
    priority: int
    confidence: float


#: Base phrases, which stay whatever else is found.
BASE = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))

#: Fixed values: (label, keyword, pattern of the name) of licenses and their versions.
NAMES = (
    ("mit", "mit", r"(?:the )?mit(?: x11| expat)?"),
    ("mit-0", "attribution", r"mit no attribution"),
    ("x11", "x11", r"(?:the )?x11"),
    ("expat", "expat", r"(?:the )?expat"),
    ("isc", "isc", r"(?:the )?isc"),
    ("0bsd", "0bsd|zero clause|0 clause bsd", r"(?:0bsd|(?:bsd )?zero clause(?: bsd)?|0 clause bsd)"),
    ("bsd-1-clause", "bsd", r"(?:1 clause bsd|bsd 1 clause)"),
    ("bsd-2-clause", "bsd|freebsd", r"(?:(?:2|two) clause(?: simplified)? bsd|bsd (?:2|two) clause|simplified bsd|freebsd)"),
    ("bsd-3-clause", "bsd", r"(?:(?:3|three) clause bsd|bsd (?:3|three) clause|(?:new|revised|modified) bsd)"),
    ("bsd-4-clause", "bsd", r"(?:(?:4|four) clause bsd|bsd (?:4|four) clause|original bsd)"),
    ("bsd", "bsd", r"(?:the )?bsd(?: style)?"),
    ("apache-1.0", "apache", r"apache(?: software)?(?: license)?(?: version)? 1 0"),
    ("apache-1.1", "apache", r"apache(?: software)?(?: license)?(?: version)? 1 1"),
    ("apache-2.0", "apache", r"apache(?: software)?(?: license)?(?: version| v)? ?2(?: 0)?"),
    ("apache", "apache", r"(?:the )?apache(?: software)?"),
    ("gpl-1.0", "gnu", r"gnu (?:gpl|general public license)(?: version)? v?1(?: 0)?"),
    ("gpl-2.0", "gpl", r"(?:gnu )?gpl(?: version)? ?v?2(?: 0)?(?: only)?"),
    ("gpl-2.0-or-later", "gpl", r"(?:gnu )?gpl(?: version)? ?v?2(?: 0)? or(?: any)? later"),
    ("gpl-3.0", "gpl", r"(?:gnu )?gpl(?: version)? ?v?3(?: 0)?(?: only)?"),
    ("gpl-3.0-or-later", "gpl", r"(?:gnu )?gpl(?: version)? ?v?3(?: 0)? or(?: any)? later"),
    ("gpl-2.0", "general public license", r"(?:gnu )?general public license(?: as published by the free software foundation)?(?: either)? version 2(?: 0)?"),
    ("gpl-3.0", "general public license", r"(?:gnu )?general public license(?: as published by the free software foundation)?(?: either)? version 3(?: 0)?"),
    ("lgpl-2.0", "lgpl", r"(?:gnu )?lgpl(?: version)? ?v?2(?: 0)?"),
    ("lgpl-2.1", "lgpl", r"(?:gnu )?lgpl(?: version)? ?v?2 1"),
    ("lgpl-3.0", "lgpl", r"(?:gnu )?lgpl(?: version)? ?v?3(?: 0)?"),
    ("lgpl", "lesser general public", r"(?:gnu )?lesser general public"),
    ("lgpl-2.1", "lesser general public license", r"(?:gnu )?lesser general public license version 2 1"),
    ("lgpl-2.0", "library general public", r"(?:gnu )?library general public"),
    ("agpl-3.0", "agpl", r"(?:gnu )?agpl(?: version)? ?v?3(?: 0)?"),
    ("agpl", "affero general public", r"(?:gnu )?affero general public"),
    ("gfdl-1.3", "free documentation", r"(?:gnu )?free documentation license version 1 3"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation"),
    ("mpl-1.0", "mozilla public", r"mozilla public license(?: version)? 1 0"),
    ("mpl-1.1", "mozilla public", r"mozilla public license(?: version)? 1 1"),
    ("mpl-2.0", "mozilla public", r"mozilla public license(?: version| v)? 2 0"),
    ("mpl", "mozilla public", r"mozilla public"),
    ("epl-1.0", "eclipse public", r"eclipse public license(?: version| v)? 1 0"),
    ("epl-2.0", "eclipse public", r"eclipse public license(?: version| v)? 2 0"),
    ("epl", "eclipse public", r"eclipse public"),
    ("cddl-1.0", "common development and distribution", r"common development and distribution license(?: version)? 1 0"),
    ("cddl", "common development and distribution", r"common development and distribution"),
    ("cpl-1.0", "common public", r"common public license(?: version)? 1 0"),
    ("eupl-1.1", "european union public", r"european union public licen[cs]e(?: version| v)? 1 1"),
    ("eupl-1.2", "european union public", r"european union public licen[cs]e(?: version| v)? 1 2"),
    ("artistic-1.0", "artistic", r"artistic license 1 0"),
    ("artistic-2.0", "artistic", r"artistic license 2 0"),
    ("artistic", "artistic", r"(?:the )?(?:perl )?artistic"),
    ("bsl-1.0", "boost software", r"boost software license(?: version)? 1 0"),
    ("boost", "boost software", r"(?:the )?boost software"),
    ("busl-1.1", "business source", r"business source license(?: version)? 1 1"),
    ("sspl-1.0", "server side public", r"server side public"),
    ("elastic-2.0", "elastic", r"elastic license(?: version)? 2 0"),
    ("zlib", "zlib", r"(?:the )?zlib(?: libpng)?"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("python-2.0", "python software foundation", r"python software foundation"),
    ("php-3.01", "php", r"php license(?: version)? 3 01"),
    ("ruby", "ruby", r"(?:the )?ruby"),
    ("postgresql", "postgresql", r"(?:the )?postgresql"),
    ("openssl", "openssl", r"(?:the )?openssl"),
    ("ofl-1.1", "open font", r"(?:sil )?open font license(?: version)? 1 1"),
    ("ofl", "open font", r"(?:sil )?open font"),
    ("odbl-1.0", "open database", r"(?:odc )?open database"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)?"),
    ("ms-pl", "microsoft public", r"microsoft public"),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal"),
    ("osl-3.0", "open software", r"open software license(?: version)? 3 0"),
    ("afl-3.0", "academic free", r"academic free license(?: version)? 3 0"),
    ("upl-1.0", "universal permissive", r"universal permissive"),
    ("blueoak-1.0.0", "blue oak", r"blue oak model"),
    ("cecill-2.1", "cecill", r"cecill(?: license)?(?: version)? 2 1"),
    ("openrail", "openrail|open rail", r"(?:creativeml |bigscience )?open ?rail(?: m)?"),
)

#: Creative Commons terms as they stand in names and in identifiers.
_CC_TERMS = (
    ("by", "attribution", "by"), ("by-sa", "attribution share ?alike", "by sa"), ("by-nd", "attribution no ?deriv(?:ative)?s?(?: works)?", "by nd"),
    ("by-nc", "attribution non ?commercial", "by nc"), ("by-nc-sa", "attribution non ?commercial share ?alike", "by nc sa"),
    ("by-nc-nd", "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?", "by nc nd"),
)
_CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")

#: Fixed values: (label, keyword, pattern, confidence) of sentences from license texts.
TEXTS = (
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software", 1.0),
    ("mit", "substantial portions", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions", 0.95),
    ("isc", "permission to use", r"permission to use copy modify and or distribute this software for any purpose with or without fee", 1.0),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted", 1.0),
    ("bsd-3-clause", "endorse or promote", r"may be used to endorse or promote products derived from this software without specific prior written permission", 0.95),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display", 0.95),
    ("apache-2.0", "apache", r"licensed under the apache license version 2 0", 1.0),
    ("apache-2.0", "you may not use this file", r"you may not use this file except in compliance with the license", 0.9),
    ("apache-2.0", "terms and conditions for use", r"terms and conditions for use reproduction and distribution", 0.9),
    ("gpl", "redistribute it and or modify", r"you can redistribute it and or modify it under the terms of the gnu general public license", 1.0),
    ("gpl-2.0-or-later", "version 2 of the license", r"either version 2 of the license or at your option any later version", 0.95),
    ("gpl-3.0-or-later", "version 3 of the license", r"either version 3 of the license or at your option any later version", 0.95),
    ("gpl", "see the gnu general public license", r"see the gnu general public license for more details", 0.9),
    ("lgpl", "gnu lesser general public", r"under the terms of the gnu lesser general public license", 1.0),
    ("agpl", "gnu affero general public", r"under the terms of the gnu affero general public license", 1.0),
    ("mpl-2.0", "mozilla public", r"subject to the terms of the mozilla public license v 2 0", 1.0),
    ("epl", "eclipse public", r"made available under the terms of the eclipse public license", 1.0),
    ("unlicense", "released into the public domain", r"free and unencumbered software released into the public domain", 1.0),
    ("cc0-1.0", "waived all copyright", r"waived all copyright and related or neighboring rights", 0.95),
    ("zlib", "provided as is without any express", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", 0.95),
    ("boost", "boost software", r"distributed under the boost software license", 1.0),
    ("wtfpl", "do what the", r"do what the fuck you want to public license", 1.0),
    ("public-domain", "public domain", r"(?:is|are|placed|released|dedicated)(?: in| into| to)? the public domain", 0.8),
    ("proprietary", "all rights reserved", r"all rights reserved", 0.3),
    ("proprietary", "confidential", r"(?:proprietary and confidential|confidential and proprietary)", 0.6),
    ("proprietary", "without the express", r"without the express(?: prior)? written (?:consent|permission)", 0.4),
    ("warranty-disclaimer", "without warrant", r"without warrant(?:y|ies)(?: or conditions)? of any kind", 0.4),
    ("warranty-disclaimer", "merchantability", r"warranties of merchantability(?: and)? fitness for a particular purpose", 0.4),
    ("copyright-notice", "copyright", r"copyright(?: c)? (?:19|20)\d\d", 0.2),
)

#: Ways to refer to a named license: (text before, text after, priority, confidence).
_REFERENCES = (
    (r"(?:licen[cs]ed|released|distributed|available|published) (?:under|with) (?:the (?:terms of )?(?:the )?)?", r"(?: licen[cs]e)?", 4, 0.9),
    (r"spdx licen[cs]e identifier ", r"", 5, 1.0),
    (r"(?:under (?:the )?)?", r" (?:licen[cs]e|licensed)", 3, 0.7),
)


def rules() -> list[Rule]:
    """All rules, in order: signatures of texts, then references to each name."""
    made = [Rule(label, pattern, keyword, 4, confidence) for label, keyword, pattern, confidence in TEXTS]
    names = list(NAMES)
    for label, words, short in _CC_TERMS:
        for version in _CC_VERSIONS:
            dotted = version.replace(" ", ".")
            names.append((f"cc-{label}-{dotted}", "creative commons", rf"creative commons {words}(?: licen[cs]e)?(?: version)? {version}"))
            names.append((f"cc-{label}-{dotted}", f"cc {short}", rf"cc {short} {version}"))
    names += [("cc0-1.0", "cc0", r"cc0(?: 1 0)?"), ("cc0-1.0", "creative commons zero", r"creative commons zero")]
    for before, after, priority, confidence in _REFERENCES:
        for label, keyword, name in names:
            made.append(Rule(label, f"{before}(?:{name}){after}", keyword, priority, confidence))
    return made


#: A text without any of these, anywhere, has no detection: every pattern holds one.
ANCHORS = ("licen", "copyright", "permission", "redistribut", "warrant", "public domain", "all rights reserved", "confidential", "advertising materials", "released", "distributed", "available", "published", "endorse or promote", "terms and conditions for use", "without the express", "do what the")
