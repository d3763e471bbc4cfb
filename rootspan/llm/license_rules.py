"""Signature rules of licenses, written by hand; each line is ``label | keywords | pattern``.

Patterns run on words in lower case with one space between them, whole words at both ends. keywords: words of which
at least one stands in whatever the pattern finds, so a text without them is never searched. Sections are in the
order of their priority: a tag outranks a license's own text, that a grant, that an address, that a name, that a hint.

In patterns LIC is licence or license, V an optional version word, GRANT the words that put something under a license.
"""

from __future__ import annotations

import re
from typing import NamedTuple

FRAGMENTS = {
    "GRANT": r"(?:(?:licen[cs]ed|released|distributed|available|published|provided|issued|offered|shared|redistributed|covered|used|contributed)(?: [^ ]+){0,3}? (?:under|by|per)(?: the)?(?: (?:terms|provisions|conditions)(?: and conditions)? of)?(?: the| an| a)?)",
    "LIC": r"licen[cs]es?",
    "V": r"(?:version |ver |v )?v?",
    "OR": r"(?: or(?: at your option)?(?: any)? later(?: version)?| plus)?",
}

TAG = """
mit | spdx | spdx LIC identifier mit(?: 0)?
apache-2 | spdx | spdx LIC identifier apache 2(?: 0)?
apache-1 | spdx | spdx LIC identifier apache 1(?: [01])?
gpl-2 | spdx | spdx LIC identifier gpl 2 0(?: only| or later| plus)?
gpl-3 | spdx | spdx LIC identifier gpl 3 0(?: only| or later| plus)?
gpl-1 | spdx | spdx LIC identifier gpl 1 0(?: only| or later)?
lgpl-2 | spdx | spdx LIC identifier lgpl 2 0(?: only| or later)?
lgpl-2.1 | spdx | spdx LIC identifier lgpl 2 1(?: only| or later)?
lgpl-3 | spdx | spdx LIC identifier lgpl 3 0(?: only| or later)?
agpl-3 | spdx | spdx LIC identifier agpl 3 0(?: only| or later)?
bsd-2 | spdx | spdx LIC identifier bsd 2 clause
bsd-3 | spdx | spdx LIC identifier bsd 3 clause(?: clear)?
bsd-4 | spdx | spdx LIC identifier bsd 4 clause
bsd-0 | spdx | spdx LIC identifier 0bsd
mpl-2 | spdx | spdx LIC identifier mpl 2 0
mpl-1.1 | spdx | spdx LIC identifier mpl 1 1
epl-2 | spdx | spdx LIC identifier epl 2 0
epl-1 | spdx | spdx LIC identifier epl 1 0
isc | spdx | spdx LIC identifier isc
zlib | spdx | spdx LIC identifier zlib
unlicense | spdx | spdx LIC identifier unlicense
wtfpl | spdx | spdx LIC identifier wtfpl
boost-1 | spdx | spdx LIC identifier bsl 1 0
busl-1.1 | spdx | spdx LIC identifier busl 1 1
cc0-1 | spdx | spdx LIC identifier cc0 1 0
cc-by | spdx | spdx LIC identifier cc by [1-4] [05]
cc-by-sa | spdx | spdx LIC identifier cc by sa [1-4] [05]
cc-by-nc | spdx | spdx LIC identifier cc by nc [1-4] [05]
cc-by-nd | spdx | spdx LIC identifier cc by nd [1-4] [05]
cc-by-nc-sa | spdx | spdx LIC identifier cc by nc sa [1-4] [05]
cc-by-nc-nd | spdx | spdx LIC identifier cc by nc nd [1-4] [05]
cddl-1 | spdx | spdx LIC identifier cddl 1 [01]
artistic-2 | spdx | spdx LIC identifier artistic 2 0
eupl-1.2 | spdx | spdx LIC identifier eupl 1 2
osl-3 | spdx | spdx LIC identifier osl 3 0
odbl-1 | spdx | spdx LIC identifier odbl 1 0
ofl-1.1 | spdx | spdx LIC identifier ofl 1 1
ncsa | spdx | spdx LIC identifier ncsa
postgresql | spdx | spdx LIC identifier postgresql
python-2 | spdx | spdx LIC identifier (?:python|psf) 2 0
vim | spdx | spdx LIC identifier vim
w3c | spdx | spdx LIC identifier w3c
"""

TEXT = """
mit | hereby | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | permission | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
isc | purpose | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | purpose | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted
bsd-2 | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd-3 | endorse | neither the name of (?:[^ ]+ ){1,12}(?:nor|or) the names of (?:its|their|any) contributors may be used to endorse or promote products
bsd-4 | acknowledgement acknowledgment | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
apache-2 | perpetual | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright LIC
apache-2 | warranties | distributed on an as is basis without warranties or conditions of any kind either express or implied
gpl-2 | copyleft freedom | the LICs for most software are designed to take away your freedom to share and change it
gpl-3 | copyleft | the gnu general public LIC is a free copyleft LIC for software and other kinds of works
agpl-3 | affero | the gnu affero general public LIC is a free copyleft LIC for software and other kinds of works
gpl | redistribute | you can redistribute it and or modify it under the terms of the gnu general public LIC
lgpl | redistribute | you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public LIC
agpl-3 | redistribute | you can redistribute it and or modify it under the terms of the gnu affero general public LIC
gpl | warranty | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public LIC
lgpl | warranty | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public LIC
gpl | gnu | you should have received a copy of the gnu general public LIC
lgpl | gnu | you should have received a copy of the gnu (?:lesser|library) general public LIC
agpl-3 | gnu | you should have received a copy of the gnu affero general public LIC
mpl-2 | mozilla | this source code form is subject to the terms of the mozilla public LIC v 2 0
mpl-1.1 | mozilla | the contents of this file are subject to the mozilla public LIC version 1 1
epl-1 | accompanying | the accompanying program is provided under the terms of this eclipse public LIC
epl-2 | eclipse | this program and the accompanying materials are made available under the terms of the eclipse public LIC 2 0
unlicense | unencumbered | this is free and unencumbered software released into the public domain
unlicense | unencumbered | free and unencumbered software
wtfpl | fuck | you just do what the fuck you want to
zlib | misrepresented | the origin of this software must not be misrepresented
zlib | plainly | altered source versions must be plainly marked as such
boost-1 | executable | obtaining a copy of the software and accompanying documentation covered by this LIC (?:[^ ]+ ){0,30}machine executable object code
cc0-1 | waives | affirmer hereby overtly fully permanently irrevocably and unconditionally waives
cc0-1 | neighboring | (?:has|have) (?:waived|dedicated) all copyright and related(?: or| and)? neighboring rights
public-domain | domain | (?:dedicate|dedicates|dedicated|placed|released)(?: [^ ]+){0,6} (?:to|in|into) the public domain
artistic-1 | package | the intent of this document is to state the conditions under which a package may be copied
ofl-1.1 | font | the font software may be sold as part of a larger software package
ofl-1.1 | stimulate | the goals of the open font LIC ofl are to stimulate worldwide development
cc-by | redistribute | you are free to share copy and redistribute the material in any medium or format
cc-by-sa | remix | if you remix transform or build upon the material you must distribute your contributions under the same LIC
cc-by-nc | commercial | you may not use the material for commercial purposes
cc-by-nd | remix | if you remix transform or build upon the material you may not distribute the modified material
gfdl | invariant | with no invariant sections no front cover texts and no back cover texts
gfdl | gfdl documentation | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation LIC
ncsa | deal | to deal with the software without restriction (?:[^ ]+ ){0,40}university of illinois
postgresql | paragraph | without a written agreement is hereby granted provided that the above copyright notice and this paragraph
python-2 | psf | subject to the terms and conditions of this LIC agreement psf hereby grants
openssl | openssl | this product includes software developed by the openssl project
w3c | w3c | by obtaining using and or copying this work you (?:[^ ]+ ){0,20}w3c
odbl-1 | database | you are free to share copy distribute and use the database
json | evil | the software shall be used for good not evil
beerware | beer | you can buy me a beer in return
x11 | advertising | shall not be used in advertising or otherwise to promote the sale use or other dealings
proprietary | confidential | (?:this|the) (?:[^ ]+ ){1,6}(?:is|are|contains?) (?:[^ ]+ ){0,4}(?:confidential and proprietary|proprietary and confidential)
proprietary | unauthorized unauthorised | unauthori[sz]ed (?:copying|use|reproduction|distribution)(?: [^ ]+){0,10} (?:is|are) (?:strictly )?prohibited
"""

GRANT = """
apache-2 | apache | GRANT apache(?: software)?(?: foundation)? LIC V2(?: 0)?
apache-2 | apache | GRANT apache V2(?: 0)?(?: LIC)?
apache-1 | apache | GRANT apache(?: software)? LIC V1 [01]
apache | apache | GRANT apache(?: software)? LIC
mit | mit | GRANT mit(?: x11)? LIC
mit | expat | GRANT expat LIC
bsd | bsd | GRANT (?:simplified |new |modified |revised |original )?bsd(?: style)? LIC
bsd-2 | bsd | GRANT (?:2|two) clause bsd LIC
bsd-3 | bsd | GRANT (?:3|three) clause bsd LIC
bsd-2 | bsd | GRANT bsd 2 clause(?: LIC)?
bsd-3 | bsd | GRANT bsd 3 clause(?: LIC)?
isc | isc | GRANT isc LIC
gpl | gpl | GRANT gpl
gpl-2 | gpl gplv2 | GRANT (?:gnu )?(?:gplv2|gpl V2(?: 0)?)OR
gpl-3 | gpl gplv3 | GRANT (?:gnu )?(?:gplv3|gpl V3(?: 0)?)OR
gpl | gnu | GRANT gnu general public LIC
gpl-2 | gnu | GRANT gnu general public LIC (?:as published by the free software foundation )?(?:either )?V2(?: 0)?OR
gpl-3 | gnu | GRANT gnu general public LIC (?:as published by the free software foundation )?(?:either )?V3(?: 0)?OR
lgpl | gnu | GRANT gnu (?:lesser|library) general public LIC
lgpl-2.1 | gnu | GRANT gnu (?:lesser|library) general public LIC V2 1OR
lgpl-3 | gnu | GRANT gnu (?:lesser|library) general public LIC V3(?: 0)?OR
lgpl-2 | gnu | GRANT gnu (?:lesser|library) general public LIC V2(?: 0)?OR
lgpl | lgpl | GRANT (?:gnu )?lgpl
lgpl-2.1 | lgpl lgplv2 | GRANT (?:gnu )?(?:lgplv2|lgpl V2) 1OR
lgpl-3 | lgpl lgplv3 | GRANT (?:gnu )?(?:lgplv3|lgpl V3)(?: 0)?OR
agpl-3 | affero | GRANT gnu affero general public LIC(?: V3(?: 0)?)?OR
agpl-3 | agpl agplv3 | GRANT (?:gnu )?(?:agplv3|agpl(?: V3(?: 0)?)?)OR
gfdl | documentation | GRANT gnu free documentation LIC
mpl-2 | mozilla | GRANT mozilla public LIC V2(?: 0)?
mpl-1.1 | mozilla | GRANT mozilla public LIC V1 1
mpl | mozilla | GRANT mozilla public LIC
mpl-2 | mpl | GRANT mpl V2(?: 0)?
epl-1 | eclipse | GRANT eclipse public LIC V1(?: 0)?
epl-2 | eclipse | GRANT eclipse public LIC V2(?: 0)?
epl | eclipse | GRANT eclipse public LIC
cddl-1 | development | GRANT common development and distribution LIC(?: cddl)?(?: V1 [01])?
cddl-1 | cddl | GRANT cddl(?: V1 [01])?
cpl-1 | common | GRANT common public LIC(?: V1 0)?
eupl | european | GRANT european union public LIC
eupl | eupl | GRANT eupl
osl-3 | open | GRANT open software LIC(?: V3 0)?
afl-3 | academic | GRANT academic free LIC(?: V3 0)?
artistic-2 | artistic | GRANT artistic LIC V2(?: 0)?
artistic-1 | artistic | GRANT (?:perl )?artistic LIC
perl | perl | (?:under|on) the same terms as perl(?: itself)?
zlib | zlib | GRANT zlib(?: libpng)? LIC
boost-1 | boost | GRANT boost software LIC(?: V1(?: 0)?)?
unlicense | unlicense | GRANT unlicense
wtfpl | wtfpl | GRANT wtfpl
ncsa | ncsa | GRANT (?:university of illinois )?ncsa(?: open source)? LIC
python-2 | python psf | GRANT (?:python software foundation|psf|python) LIC
ofl-1.1 | font | GRANT (?:sil )?open font LIC(?: V1 1)?
ms-pl | microsoft | GRANT microsoft public LIC
ms-rl | microsoft | GRANT microsoft reciprocal LIC
busl-1.1 | business | GRANT business source LIC(?: V1 1)?
sspl-1 | server | GRANT server side public LIC
elastic-2 | elastic | GRANT elastic LIC(?: V2(?: 0)?)?
odbl-1 | database odbl | GRANT (?:open data commons )?(?:open database LIC|odbl)
ogl-3 | government | GRANT open government LIC(?: V3(?: 0)?)?
openrail | openrail rail | GRANT (?:bigscience |creativeml )?(?:openrail|open rail)(?: [ms])?(?: LIC)?
llama | llama | GRANT llama (?:[0-9] ){0,2}community LIC
cc-by | cc | GRANT cc by(?: LIC)?(?: V[1-4] [05])?
cc-by-sa | cc | GRANT cc by sa(?: LIC)?(?: V[1-4] [05])?
cc-by-nc | cc | GRANT cc by nc(?: LIC)?(?: V[1-4] [05])?
cc-by-nd | cc | GRANT cc by nd(?: LIC)?(?: V[1-4] [05])?
cc-by-nc-sa | cc | GRANT cc by nc sa(?: LIC)?(?: V[1-4] [05])?
cc-by-nc-nd | cc | GRANT cc by nc nd(?: LIC)?(?: V[1-4] [05])?
cc-by | creative | GRANT creative commons attribution(?: LIC)?(?: V[1-4] [05])?
cc-by-sa | creative | GRANT creative commons attribution share ?alike(?: LIC)?(?: V[1-4] [05])?
cc-by-nc | creative | GRANT creative commons attribution non ?commercial(?: LIC)?(?: V[1-4] [05])?
cc-by-nd | creative | GRANT creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: LIC)?(?: V[1-4] [05])?
cc-by-nc-sa | creative | GRANT creative commons attribution non ?commercial share ?alike(?: LIC)?(?: V[1-4] [05])?
cc-by-nc-nd | creative | GRANT creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: LIC)?(?: V[1-4] [05])?
cc0-1 | cc0 | GRANT cc0(?: 1 0)?(?: universal)?
cc | creative | GRANT creative commons LIC
public-domain | domain | (?:is|are|was|were) (?:now )?in the public domain
reserved | reserved | copyright (?:[^ ]+ ){1,10}all rights reserved
proprietary | proprietary | GRANT proprietary LIC
commercial | commercial | GRANT commercial LIC
"""

ADDRESS = """
apache-2 | apache | (?:www )?apache org LIC LIC 2 0(?: txt| html)?
mit | opensource | (?:www )?opensource org LICs? mit(?: LIC)?(?: php| html)?
bsd-2 | opensource | (?:www )?opensource org LICs? bsd 2 clause
bsd-3 | opensource | (?:www )?opensource org LICs? bsd 3 clause
bsd | opensource | (?:www )?opensource org LICs? bsd LIC(?: php)?
isc | opensource | (?:www )?opensource org LICs? isc
gpl-2 | opensource | (?:www )?opensource org LICs? gpl 2 0
gpl-3 | opensource | (?:www )?opensource org LICs? gpl 3 0
artistic-2 | opensource | (?:www )?opensource org LICs? artistic LIC 2 0
gpl | gnu | (?:www )?gnu org (?:LIC|copyleft) gpl(?: html| txt)?
gpl-2 | gnu | (?:www )?gnu org LIC(?: old LIC)? gpl 2 0
gpl-3 | gnu | (?:www )?gnu org LIC gpl 3 0
lgpl | gnu | (?:www )?gnu org (?:LIC|copyleft) (?:lgpl|lesser)(?: html| txt)?
lgpl-2.1 | gnu | (?:www )?gnu org LIC(?: old LIC)? lgpl 2 1
lgpl-3 | gnu | (?:www )?gnu org LIC lgpl 3 0
agpl-3 | gnu | (?:www )?gnu org LIC agpl(?: 3 0)?
gfdl | gnu | (?:www )?gnu org (?:LIC|copyleft) fdl
mpl-2 | mozilla | (?:www )?mozilla org mpl 2 0
mpl-1.1 | mozilla | (?:www )?mozilla org mpl(?: mpl 1 1)?
epl-1 | eclipse | (?:www )?eclipse org (?:legal|org documents) epl v10(?: html)?
epl-2 | eclipse | (?:www )?eclipse org legal epl (?:2 0|v20)
cc-by | creativecommons | (?:www )?creativecommons org LICs? by [1-4] [05]
cc-by-sa | creativecommons | (?:www )?creativecommons org LICs? by sa [1-4] [05]
cc-by-nc | creativecommons | (?:www )?creativecommons org LICs? by nc [1-4] [05]
cc-by-nd | creativecommons | (?:www )?creativecommons org LICs? by nd [1-4] [05]
cc-by-nc-sa | creativecommons | (?:www )?creativecommons org LICs? by nc sa [1-4] [05]
cc-by-nc-nd | creativecommons | (?:www )?creativecommons org LICs? by nc nd [1-4] [05]
cc0-1 | creativecommons | (?:www )?creativecommons org publicdomain zero 1 0
public-domain | creativecommons | (?:www )?creativecommons org publicdomain mark 1 0
unlicense | unlicense | (?:www )?unlicense org
wtfpl | wtfpl | (?:www )?wtfpl net
boost-1 | boost | (?:www )?boost org LIC 1 0(?: txt)?
ofl-1.1 | scripts | scripts sil org ofl
zlib | zlib | (?:www )?zlib net zlib LIC
odbl-1 | opendatacommons | opendatacommons org LICs? odbl
pddl-1 | opendatacommons | opendatacommons org LICs? pddl
odc-by-1 | opendatacommons | opendatacommons org LICs? by
ogl-3 | nationalarchives | (?:www )?nationalarchives gov uk doc open government LIC
"""

NAME = """
apache-2 | apache | apache(?: software)?(?: foundation)? LIC V2(?: 0)?
apache-2 | apache | apache V2 0
apache-1 | apache | apache(?: software)? LIC V1 [01]
apache | apache | apache(?: software)? LIC
mit | mit | (?:the )?mit(?: x11)? LIC
mit | expat | expat LIC
bsd | bsd | (?:simplified |new |modified |revised |original )?bsd(?: style)? LIC
bsd-2 | bsd | (?:(?:2|two) clause bsd|bsd (?:2|two) clause)(?: LIC)?
bsd-3 | bsd | (?:(?:3|three) clause bsd|bsd (?:3|three) clause)(?: LIC)?
bsd-4 | bsd | (?:(?:4|four) clause bsd|bsd (?:4|four) clause)(?: LIC)?
bsd-0 | 0bsd bsd | (?:0bsd|zero clause bsd|bsd zero clause)(?: LIC)?
isc | isc | isc LIC
gpl | gnu | gnu (?:general public LIC|gpl)
gpl-2 | gnu | gnu (?:general public LIC|gpl) V2(?: 0)?OR
gpl-3 | gnu | gnu (?:general public LIC|gpl) V3(?: 0)?OR
gpl-2 | gpl gplv2 | (?:gplv2|gpl V2(?: 0)?)OR
gpl-3 | gpl gplv3 | (?:gplv3|gpl V3(?: 0)?)OR
lgpl | gnu | gnu (?:lesser|library) general public LIC
lgpl-2 | gnu | gnu (?:lesser|library) general public LIC V2(?: 0)?OR
lgpl-2.1 | gnu | gnu (?:lesser|library) general public LIC V2 1OR
lgpl-3 | gnu | gnu (?:lesser|library) general public LIC V3(?: 0)?OR
lgpl-2.1 | lgpl lgplv2 | (?:lgplv2|lgpl V2) 1OR
lgpl-3 | lgpl lgplv3 | (?:lgplv3|lgpl V3)(?: 0)?OR
agpl-3 | affero | (?:gnu )?affero general public LIC(?: V3(?: 0)?)?OR
agpl-3 | agpl agplv3 | (?:agplv3|agpl V3(?: 0)?)OR
gfdl | documentation | gnu free documentation LIC(?: V1 [1-3])?
mpl-1.1 | mozilla | mozilla public LIC V1 1
mpl-2 | mozilla | mozilla public LIC V2(?: 0)?
mpl | mozilla | mozilla public LIC
mpl-2 | mpl | mpl V2(?: 0)?
epl-1 | eclipse | eclipse public LIC V1(?: 0)?
epl-2 | eclipse | eclipse public LIC V2(?: 0)?
epl | eclipse | eclipse public LIC
cddl-1 | development | common development and distribution LIC(?: cddl)?(?: V1 [01])?
cpl-1 | common | common public LIC(?: V1 0)?
eupl | european | european union public LIC(?: V1 [12])?
osl-3 | open | open software LIC(?: V3 0)?
afl-3 | academic | academic free LIC(?: V3 0)?
artistic-2 | artistic | artistic LIC V2(?: 0)?
artistic-1 | artistic | artistic LIC
zlib | zlib | zlib(?: libpng)? LIC
boost-1 | boost | boost software LIC(?: V1(?: 0)?)?
unlicense | unlicense | the unlicense
wtfpl | wtfpl | wtfpl
ncsa | ncsa | ncsa open source LIC
postgresql | postgresql | postgresql LIC
python-2 | python psf | (?:python software foundation|psf) LIC(?: agreement)?(?: V2)?
openssl | openssl | openssl LIC
ofl-1.1 | font | sil open font LIC(?: V1 1)?
ms-pl | microsoft | microsoft public LIC
ms-rl | microsoft | microsoft reciprocal LIC
busl-1.1 | business | business source LIC(?: V1 1)?
sspl-1 | server | server side public LIC(?: V1)?
elastic-2 | elastic | elastic LIC V2(?: 0)?
ipl-1 | ibm | ibm public LIC
npl-1 | netscape | netscape public LIC
qpl-1 | q | q public LIC
sleepycat | sleepycat | sleepycat LIC
php-3 | php | php LIC(?: V3 [0-9]+)?
ruby | ruby | ruby LIC
tcl | tcl | tcl tk LIC
vim | vim | vim LIC
w3c | w3c | w3c software(?: notice)?(?: and)? LIC
odbl-1 | database | open database LIC
odc-by-1 | attribution | open data commons attribution LIC
pddl-1 | public | public domain dedication and LIC
ogl-3 | government | open government LIC(?: V3(?: 0)?)?
openrail | openrail rail | (?:creativeml |bigscience )?(?:openrail|open rail)(?: [ms])? LIC
llama | llama | llama (?:[0-9] ){0,2}community LIC(?: agreement)?
cc-by | cc | cc by [1-4] [05]
cc-by-sa | cc | cc by sa(?: [1-4] [05])?
cc-by-nc | cc | cc by nc(?: [1-4] [05])?
cc-by-nd | cc | cc by nd(?: [1-4] [05])?
cc-by-nc-sa | cc | cc by nc sa(?: [1-4] [05])?
cc-by-nc-nd | cc | cc by nc nd(?: [1-4] [05])?
cc-by | creative | creative commons attribution(?: [1-4] [05])?(?: international)?(?: LIC)?
cc-by-sa | creative | creative commons attribution share ?alike(?: [1-4] [05])?(?: international)?(?: LIC)?
cc-by-nc | creative | creative commons attribution non ?commercial(?: [1-4] [05])?(?: international)?(?: LIC)?
cc-by-nd | creative | creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?(?: international)?(?: LIC)?
cc-by-nc-sa | creative | creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international)?(?: LIC)?
cc-by-nc-nd | creative | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?(?: international)?(?: LIC)?
cc0-1 | cc0 | cc0(?: 1 0)?(?: universal)?
cc | creative | creative commons(?: LIC)?
"""

HINT = """
reserved | reserved | all rights reserved
reserved | reserved | some rights reserved
public-domain | domain | public domain
gpl | gpl | gpl
lgpl | lgpl | lgpl
agpl-3 | agpl | agpl
other | license licence licenses licences | (?:see|read) (?:the )?(?:accompanying |included )?LIC (?:file )?for (?:[^ ]+ ){0,2}(?:details|information|terms)
other | terms | subject to (?:the )?(?:[^ ]+ ){0,3}LIC terms
commercial | commercial | non commercial use only
"""

#: Sections from the highest priority to the lowest, with how much a finding of one says.
SECTIONS = ((TAG, 1.0), (TEXT, 0.99), (GRANT, 0.95), (ADDRESS, 0.9), (NAME, 0.8), (HINT, 0.4))


class Rule(NamedTuple):
    number: int
    priority: int
    weight: float
    label: str
    keywords: frozenset[bytes]
    text: str

    def pattern(self) -> re.Pattern[bytes]:
        return re.compile(rf"(?<![^ ])(?:{self.text})(?![^ ])".encode())


def expanded(text: str) -> str:
    for name, to in FRAGMENTS.items():
        text = text.replace(name, to)
    return text


def rules() -> list[Rule]:
    out: list[Rule] = []
    for priority, (section, weight) in enumerate(SECTIONS):
        for line in section.strip().splitlines():
            label, keywords, text = (x.strip() for x in line.split(" | "))
            out.append(Rule(len(out), priority, weight, label, frozenset(k.encode() for k in keywords.split()), expanded(text)))
    return out
