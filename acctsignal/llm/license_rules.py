"""Signatures of licences: regular expressions over a text's lower-case words, one space between words.

A rule has a name, a label, keywords of which a text must contain one for the rule to be tried, a priority (a detection
hides what lies inside it and has no higher priority) and a confidence. Texts without any rule's keyword are not scanned.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Rule(NamedTuple):
    name: str
    label: str
    keywords: tuple[str, ...]
    priority: int
    confidence: float
    regex: str


#: Phrases that are always looked for, with their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

_V = r"(?: version| v)?"

#: Label, keywords, the licence's name, and its short name in tags (also over words).
NAMES = [
    ("mit", "mit licen|expat licen", r"(?:mit|expat) licen[cs]e", r"mit"),
    ("mit-0", "mit no attribution|mit 0", r"mit no attribution(?: licen[cs]e)?", r"mit 0"),
    ("apache-1.1", "apache", rf"apache(?: software)? licen[cs]e{_V} 1 1", r"apache 1 1"),
    ("apache-2", "apache", rf"apache(?: software)? licen[cs]e{_V} 2(?: 0)?", r"apache 2(?: 0)?"),
    ("bsd-2-clause", "bsd", r"(?:simplified bsd|bsd 2 clause|2 clause bsd|freebsd|two clause bsd)(?: licen[cs]e)?", r"bsd 2 clause"),
    ("bsd-3-clause", "bsd", r"(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)(?: licen[cs]e)?", r"bsd 3 clause"),
    ("bsd-4-clause", "bsd", r"(?:original bsd|bsd 4 clause|4 clause bsd)(?: licen[cs]e)?", r"bsd 4 clause"),
    ("0bsd", "bsd|free public", r"(?:zero clause bsd|bsd zero clause|free public)(?: licen[cs]e)?(?: 1 0 0)?", r"0bsd"),
    ("gpl-1", "general public|gpl", rf"(?:gnu )?(?:general public licen[cs]e|gpl){_V} ?1(?: 0)?", r"gpl 1 0(?: only| or later)?"),
    ("gpl-2", "general public|gpl", rf"(?:gnu )?(?:general public licen[cs]e|gpl)(?: as published by the free software foundation)?(?: either)?{_V} ?2(?: 0)?", r"gpl 2 0(?: only| or later)?"),
    ("gpl-3", "general public|gpl", rf"(?:gnu )?(?:general public licen[cs]e|gpl)(?: as published by the free software foundation)?(?: either)?{_V} ?3(?: 0)?", r"gpl 3 0(?: only| or later)?"),
    ("lgpl-2", "library general public|lgpl", rf"(?:gnu )?(?:library general public licen[cs]e|lgpl){_V} ?2(?: 0)?", r"lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", "lesser general public|lgpl", rf"(?:gnu )?(?:lesser general public licen[cs]e|lgpl){_V} ?2 1", r"lgpl 2 1(?: only| or later)?"),
    ("lgpl-3", "lesser general public|lgpl", rf"(?:gnu )?(?:lesser general public licen[cs]e|lgpl){_V} ?3(?: 0)?", r"lgpl 3 0(?: only| or later)?"),
    ("agpl-3", "affero general public|affero gpl|agpl", rf"(?:gnu )?(?:affero general public licen[cs]e|affero gpl|agpl){_V} ?3(?: 0)?", r"agpl 3 0(?: only| or later)?"),
    ("gfdl", "free documentation|gfdl", rf"(?:gnu free documentation licen[cs]e|gfdl)(?:{_V} 1 [123])?", r"gfdl 1 [123](?: only| or later)?"),
    ("mpl-1.1", "mozilla public|mpl", rf"mozilla public licen[cs]e{_V} 1 1", r"mpl 1 1"),
    ("mpl-2", "mozilla public|mpl", rf"mozilla public licen[cs]e{_V} 2(?: 0)?", r"mpl 2 0"),
    ("epl-1", "eclipse public|epl", rf"eclipse public licen[cs]e{_V} 1(?: 0)?", r"epl 1 0"),
    ("epl-2", "eclipse public|epl", rf"eclipse public licen[cs]e{_V} 2(?: 0)?", r"epl 2 0"),
    ("cddl", "common development|cddl", rf"common development and distribution licen[cs]e(?:{_V} 1 [01])?", r"cddl 1 [01]"),
    ("cpl-1", "common public|cpl", rf"common public licen[cs]e(?:{_V} 1 0)?", r"cpl 1 0"),
    ("eupl", "european union public|eupl", rf"european union public licen[cs]e(?:{_V} 1 [012])?", r"eupl 1 [012]"),
    ("isc", "isc licen", r"isc licen[cs]e", r"isc"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e", r"zlib"),
    ("bsl-1", "boost software|bsl", rf"boost software licen[cs]e(?:{_V} 1 0)?", r"bsl 1 0"),
    ("wtfpl", "do what the fuck|wtfpl", r"do what the fuck you want to public licen[cs]e", r"wtfpl"),
    ("unlicense", "unlicen", r"unlicen[cs]e", r"unlicense"),
    ("artistic-1", "artistic", rf"artistic licen[cs]e{_V} 1 0", r"artistic 1 0"),
    ("artistic-2", "artistic", rf"artistic licen[cs]e{_V} 2(?: 0)?", r"artistic 2 0"),
    ("python-2", "python|psf", r"python software foundation licen[cs]e(?: version 2)?", r"(?:psf|python) 2 0"),
    ("php-3", "php", rf"php licen[cs]e(?:{_V} 3 01?)?", r"php 3 01?"),
    ("ofl-1.1", "open font|ofl", rf"sil open font licen[cs]e(?:{_V} 1 1)?", r"ofl 1 1"),
    ("odbl-1", "open database|odbl", r"(?:open database licen[cs]e|open data commons open database licen[cs]e)(?: v?1 0)?", r"odbl 1 0"),
    ("odc-by", "open data commons|odc by", r"open data commons attribution licen[cs]e(?: v?1 0)?", r"odc by 1 0"),
    ("pddl", "public domain dedication|pddl", r"(?:open data commons )?public domain dedication and licen[cs]e", r"pddl 1 0"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e", r"postgresql"),
    ("openssl", "openssl", r"openssl licen[cs]e", r"openssl"),
    ("ms-pl", "microsoft public|ms pl", r"microsoft public licen[cs]e", r"ms pl"),
    ("ms-rl", "microsoft reciprocal|ms rl", r"microsoft reciprocal licen[cs]e", r"ms rl"),
    ("upl-1", "universal permissive|upl", rf"universal permissive licen[cs]e(?:{_V} 1 0)?", r"upl 1 0"),
    ("ncsa", "ncsa", r"university of illinois ncsa open source licen[cs]e", r"ncsa"),
    ("afl-3", "academic free|afl", rf"academic free licen[cs]e(?:{_V} 3 0)?", r"afl 3 0"),
    ("osl-3", "open software|osl", rf"open software licen[cs]e(?:{_V} 3 0)?", r"osl 3 0"),
    ("busl-1.1", "business source|busl", rf"business source licen[cs]e(?:{_V} 1 1)?", r"busl 1 1"),
    ("sspl-1", "server side public|sspl", rf"server side public licen[cs]e(?:{_V} 1)?", r"sspl 1 0"),
    ("elastic-2", "elastic", rf"elastic licen[cs]e(?:{_V} 2 0)?", r"elastic 2 0"),
]

#: Label, keywords, name and short name of the licences that also stand without the word "license".
COMMONS = [
    ("cc0", "cc0|cc zero|creative commons", r"(?:cc0|cc zero|creative commons zero)(?: 1 0)?(?: universal)?", r"cc0 1 0"),
    ("cc-by", "cc by|creative commons", r"(?:cc by|creative commons attribution) ?(?:[1234] [05])?(?: international| unported| generic)?", r"cc by [1234] [05]"),
    ("cc-by-sa", "cc by|creative commons", r"(?:cc by sa|creative commons attribution share ?alike) ?(?:[1234] [05])?(?: international| unported| generic)?", r"cc by sa [1234] [05]"),
    ("cc-by-nd", "cc by|creative commons", r"(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s) ?(?:[1234] [05])?(?: international| unported| generic)?", r"cc by nd [1234] [05]"),
    ("cc-by-nc", "cc by|creative commons", r"(?:cc by nc|creative commons attribution non ?commercial) ?(?:[1234] [05])?(?: international| unported| generic)?", r"cc by nc [1234] [05]"),
    ("cc-by-nc-sa", "cc by|creative commons", r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike) ?(?:[1234] [05])?(?: international| unported| generic)?", r"cc by nc sa [1234] [05]"),
    ("cc-by-nc-nd", "cc by|creative commons", r"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s) ?(?:[1234] [05])?(?: international| unported| generic)?", r"cc by nc nd [1234] [05]"),
]

#: How a text says that it is under a licence; {} is the licence's name. Priority and confidence of the statement.
STATEMENTS = [
    ("notice", r"(?:is |are |be |been |was )?(?:re)?(?:licen[cs]ed|released|distributed|published|provided|made available|available|shared) (?:to you )?under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?{}", 3, 0.95),
    ("terms", r"(?:under|subject to|governed by|in accordance with|pursuant to) (?:the )?(?:terms|conditions|provisions)(?: and conditions)? of (?:the )?{}", 3, 0.9),
    ("field", r"licen[cs]e(?:s|d)? (?:is |name |type |id |file )?(?:the )?{}", 2, 0.8),
    ("named", r"{}", 1, 0.6),
]

#: Sentences of the licences themselves, notices and addresses.
BODIES = [
    ("mit", "free of charge to any person obtaining", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "above copyright notice and this permission", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("isc", "permission to use copy", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that"),
    ("0bsd", "permission to use copy", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software"),
    ("bsd-2-clause", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-3-clause", "endorse or promote", r"neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("apache-2", "www apache org", r"you may not use this file except in compliance with the licen[cs]e you may obtain a copy of the licen[cs]e at https? www apache org licenses license 2 0"),
    ("apache-2", "www apache org", r"https? www apache org licenses license 2 0(?: txt| html)?"),
    ("apache-1.1", "apache software foundation", r"this product includes software developed by the apache software foundation"),
    ("gpl", "received a copy of the gnu", r"you should have received a copy of the gnu general public licen[cs]e along with this program"),
    ("gpl", "www gnu org", r"https? www gnu org licenses gpl(?: [123] 0)?(?: txt| html)?"),
    ("lgpl", "received a copy of the gnu", r"you should have received a copy of the gnu lesser general public licen[cs]e along with this (?:library|program)"),
    ("lgpl", "www gnu org", r"https? www gnu org licenses lgpl(?: [23] [01])?(?: txt| html)?"),
    ("agpl", "www gnu org", r"https? www gnu org licenses agpl(?: 3 0)?(?: txt| html)?"),
    ("mpl-2", "mozilla public", r"this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0"),
    ("mpl-2", "mozilla org", r"https? (?:www )?mozilla org mpl 2 0"),
    ("zlib", "permission is granted to anyone", r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("bsl-1", "person or organization obtaining", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this licen[cs]e"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("public-domain", "public domain", r"(?:released|dedicated|placed|put|is) (?:in|into|to) the public domain"),
    ("cc", "creativecommons org", r"https? creativecommons org licenses (?:by|by sa|by nc|by nd|by nc sa|by nc nd) [1234] [05]"),
    ("cc0", "creativecommons org", r"https? creativecommons org publicdomain zero 1 0"),
    ("ofl-1.1", "scripts sil org", r"https? scripts sil org ofl"),
    ("proprietary", "unauthori|no part", r"(?:unauthori[sz]ed copying|no part) of this (?:file|publication|work|software) .{1,80}? (?:is strictly prohibited|may be reproduced)"),
    ("all-rights-reserved", "rights reserved", r"all rights reserved"),
]

#: Families whose version is not told.
FAMILIES = [
    ("gpl", "gnu", r"gnu (?:general public licen[cs]e|gpl)"),
    ("lgpl", "gnu", r"gnu (?:lesser general public licen[cs]e|lgpl)"),
    ("agpl", "gnu", r"gnu (?:affero general public licen[cs]e|agpl)"),
    ("bsd", "bsd", r"bsd(?: style)? licen[cs]e"),
    ("mpl", "mozilla public", r"mozilla public licen[cs]e"),
    ("epl", "eclipse public", r"eclipse public licen[cs]e"),
    ("apache", "apache", r"apache(?: software)? licen[cs]e"),
    ("artistic", "artistic", r"artistic licen[cs]e"),
    ("cc", "creative commons", r"creative commons licen[cs]e"),
]


#: How a text names a licence by its short name, {}, and what it then contains.
SHORT_STATEMENTS = [
    ("under", r"(?:(?:re)?(?:licen[cs]ed|released|distributed|published|provided|available|shared) )?under (?:the )?{}",
     ("under {}", "under the {}"), 2, 0.8),
    ("licensed", r"{} licen[cs]ed", (" {} licen",), 2, 0.8),
    ("value", r"licen[cs]ed? (?:is |type )?{}(?: or later)?",
     ("license {}", "licence {}", "licensed {}", "license is {}", "licence is {}", "license type {}"), 2, 0.8),
]


#: Keywords that only count at the start of a word, as they are parts of ordinary words.
WHOLE_WORDS = {"gnu", "gpl", "lgpl", "agpl", "gfdl", "mpl", "epl", "cddl", "cpl", "eupl", "bsl", "ofl", "odbl", "pddl", "upl",
               "afl", "osl", "busl", "sspl", "psf", "php", "ncsa"}
#: Licences whose short name is also a plain word.
SENTENCE_WORDS = {"unlicense"}


def literal(pattern: str) -> str:
    """The plain text that a pattern begins with."""
    return re.split(r"[(\[]", pattern, maxsplit=1)[0].rstrip()


#: A text needs one of these to be scanned: every rule's expression needs one, if only the word license.
GATES = ["licen", "gpl", "cc by", "cc0", "cc zero", "creative", "public domain", "publicdomain", "permission", "redistribution",
         "rights reserved", "copyright", "apache", "www gnu", "mozilla org", "scripts sil", "unauthori", "no part of", "under ",
         "bsd", "gfdl", "mit no", "free public", "advertising materials"]


def rules() -> list[Rule]:
    """Base phrases, sentences, families, and every licence in every kind of statement. Keywords are parted by |."""
    found = [Rule(f"base:{label}", label, (phrase,), 2, 1.0, phrase) for phrase, label in BASE.items()]
    found += [Rule(f"body:{label}:{i}", label, tuple(keywords.split("|")), 4, 0.98, regex)
              for i, (label, keywords, regex) in enumerate(BODIES)]
    found += [Rule(f"family:{label}", label, tuple(keywords.split("|")), 1, 0.5, regex)
              for label, keywords, regex in FAMILIES]
    for label, keywords, name, short in NAMES + COMMONS:
        found.append(Rule(f"tag:{label}", label, ("spdx licen",), 4, 1.0, rf"spdx licen[cs]e identifier {short}"))
        found += [Rule(f"{kind}:{label}", label, tuple(keywords.split("|")), priority, confidence,
                       statement.format(f"(?:{name})")) for kind, statement, priority, confidence in STATEMENTS]
        if label not in SENTENCE_WORDS and literal(short):
            found += [Rule(f"{kind}:{label}", label, tuple(k.format(literal(short)) for k in keys), priority, confidence,
                           statement.format(short)) for kind, statement, keys, priority, confidence in SHORT_STATEMENTS]
    return [r._replace(keywords=tuple(f" {k}" if k in WHOLE_WORDS else k for k in r.keywords)) for r in found]


#: Highest priority of a rule.
PRIORITIES = 4
