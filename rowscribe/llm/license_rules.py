"""License rules: ordered regular expressions over normalised words.

Each license has the names it goes by; each name is put into every phrase form
of its family, so ``RULES`` holds some hundreds of expressions. Fixed values.
"""

from __future__ import annotations

#: Label -> (names, as expressions over lower-case words; kind).
LICENSES = {
    "mit": (["mit", "expat", "mit expat", "x11 mit"], "named"),
    "mit-0": (["mit 0", "mit no attribution"], "named"),
    "apache-1.1": (["apache(?: software)?(?: license)?(?: version)? 1 1"], "named"),
    "apache-2": (["apache(?: software)?(?: license)?(?: version)? 2(?: 0)?", "apache 2"], "named"),
    "bsd-2": (["bsd 2 clause", "2 clause bsd", "simplified bsd", "freebsd"], "named"),
    "bsd-3": (["bsd 3 clause", "3 clause bsd", "new bsd", "modified bsd", "revised bsd"], "named"),
    "bsd-4": (["bsd 4 clause", "4 clause bsd", "original bsd"], "named"),
    "0bsd": (["0bsd", "zero clause bsd", "bsd zero clause"], "named"),
    "isc": (["isc"], "named"),
    "zlib": (["zlib", "zlib libpng"], "named"),
    "boost-1": (["boost(?: software)?(?: license)?(?: version)? 1(?: 0)?", "bsl 1 0"], "named"),
    "unlicense": (["unlicense"], "named"),
    "wtfpl": (["wtfpl", "do what the fuck you want to public"], "named"),
    "gpl-1": (["gnu general public(?: license)?(?: version)? 1(?: 0)?", "gpl ?v?1(?: 0)?"], "named"),
    "gpl-2": (["gnu general public(?: license)?(?: version)? 2(?: 0)?", "gpl(?: version)? ?v?2(?: 0)?"], "named"),
    "gpl-3": (["gnu general public(?: license)?(?: version)? 3(?: 0)?", "gpl(?: version)? ?v?3(?: 0)?"], "named"),
    "lgpl-2": (["gnu library general public(?: license)?(?: version)? 2(?: 0)?", "lgpl(?: version)? ?v?2(?: 0)?"], "named"),
    "lgpl-2.1": (["gnu lesser general public(?: license)?(?: version)? 2 1", "lgpl(?: version)? ?v?2 1"], "named"),
    "lgpl-3": (["gnu lesser general public(?: license)?(?: version)? 3(?: 0)?", "lgpl(?: version)? ?v?3(?: 0)?"], "named"),
    "agpl-3": (["gnu affero general public(?: license)?(?: version)? 3(?: 0)?", "agpl(?: version)? ?v?3(?: 0)?"], "named"),
    "gfdl-1.2": (["gnu free documentation(?: license)?(?: version)? 1 2", "gfdl 1 2"], "named"),
    "gfdl-1.3": (["gnu free documentation(?: license)?(?: version)? 1 3", "gfdl 1 3"], "named"),
    "mpl-1.1": (["mozilla public(?: license)?(?: version)? 1 1", "mpl 1 1"], "named"),
    "mpl-2": (["mozilla public(?: license)?(?: version)? 2(?: 0)?", "mpl 2(?: 0)?"], "named"),
    "epl-1": (["eclipse public(?: license)?(?: version)? 1(?: 0)?", "epl 1(?: 0)?"], "named"),
    "epl-2": (["eclipse public(?: license)?(?: version)? 2(?: 0)?", "epl 2(?: 0)?"], "named"),
    "cddl-1": (["common development and distribution(?: license)?(?: version)? 1(?: 0)?", "cddl 1(?: 0)?"], "named"),
    "cpl-1": (["common public(?: license)?(?: version)? 1(?: 0)?"], "named"),
    "eupl-1.2": (["european union public(?: licence| license)?(?: version| v)? ?1 2", "eupl ?v?1 2"], "named"),
    "artistic-1": (["artistic(?: license)?(?: version)? 1(?: 0)?"], "named"),
    "artistic-2": (["artistic(?: license)?(?: version)? 2(?: 0)?"], "named"),
    "ofl-1.1": (["sil open font(?: license)?(?: version)? 1 1", "ofl 1 1"], "named"),
    "ncsa": (["university of illinois ncsa", "ncsa"], "named"),
    "postgresql": (["postgresql"], "named"),
    "python-2": (["python software foundation", "psf(?: version)? 2"], "named"),
    "php-3": (["php(?: license)?(?: version)? 3(?: 0| 01)?"], "named"),
    "ms-pl": (["microsoft public", "ms pl"], "named"),
    "ms-rl": (["microsoft reciprocal", "ms rl"], "named"),
    "upl-1": (["universal permissive(?: license)?(?: version)? 1(?: 0)?"], "named"),
    "odbl-1": (["open database(?: license)?(?: version)? 1(?: 0)?", "odbl"], "named"),
    "cc0": (["cc0", "cc zero", "creative commons zero"], "cc"),
    "cc-by": (["cc by", "creative commons attribution"], "cc"),
    "cc-by-sa": (["cc by sa", "creative commons attribution share ?alike"], "cc"),
    "cc-by-nd": (["cc by nd", "creative commons attribution no ?deriv(?:s|atives)"], "cc"),
    "cc-by-nc": (["cc by nc", "creative commons attribution non ?commercial"], "cc"),
    "cc-by-nc-sa": (["cc by nc sa", "creative commons attribution non ?commercial share ?alike"], "cc"),
    "cc-by-nc-nd": (["cc by nc nd", "creative commons attribution non ?commercial no ?deriv(?:s|atives)"], "cc"),
    "gpl": (["gnu general public", "gnu gpl"], "family"),
    "lgpl": (["gnu lesser general public", "gnu lgpl"], "family"),
    "agpl": (["gnu affero general public", "gnu agpl"], "family"),
    "bsd": (["bsd"], "family"),
    "apache": (["apache", "apache software"], "family"),
    "mpl": (["mozilla public"], "family"),
    "public-domain": (["public domain"], "domain"),
    "proprietary": (["all rights reserved"], "bare"),
}
_WORD = "(?:license|licence|licenses)"
#: Forms by kind: (priority, expression around the name).
FORMS = {
    "named": [
        (90, f"(?:licen[sc]ed|released|distributed|available|published|provided|covered) under(?: the)?(?: terms of(?: the)?)? {{}}(?: {_WORD})?"),
        (80, f"under(?: the)?(?: terms of(?: the)?)? {{}} {_WORD}"),
        (80, f"governed by(?: the)? {{}}(?: {_WORD})?"),
        (70, f"spdx {_WORD} identifier {{}}"),
        (60, f"{_WORD} {{}}"),
        (50, f"{{}} {_WORD}(?: version \\d+(?: \\d+)?)?"),
    ],
    "cc": [(90, f"(?:licen[sc]ed|released|distributed|available|published) under(?: a| an| the)? {{}}(?: {_WORD})?(?: \\d \\d)?(?: \\w+)?"), (70, f"spdx {_WORD} identifier {{}}"), (60, f"{_WORD} {{}}(?: \\d \\d)?"), (50, "{}(?: \\d \\d)?")],
    "family": [(40, f"(?:licen[sc]ed|released|distributed) under(?: the)?(?: terms of(?: the)?)? {{}}(?: {_WORD})?"), (30, f"{{}} {_WORD}")],
    "domain": [(40, "(?:in|into|to) the {}"), (30, "{} dedication")],
    "bare": [(20, "{}")],
}
#: (priority, label, expression), higher priorities first; the order of writing decides between equals.
RULES = sorted(
    ((priority, label, form.format(f"(?:{name})")) for label, (names, kind) in LICENSES.items() for priority, form in FORMS[kind] for name in names),
    key=lambda rule: -rule[0],
)
#: A text without any of these words can match no rule and no base phrase.
KEYWORDS = ["license", "licence", "licenses", "licensed", "licenced", "released", "distributed", "available", "published", "provided", "covered", "governed", "spdx", "cc", "cc0", "creative", "public", "rights", "under"]
#: The base phrases; their labels always stay.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
