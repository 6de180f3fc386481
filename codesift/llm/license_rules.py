"""Signatures of licences, in order. Each line: label, words that must occur, pattern; sections go from strong to weak.

Patterns are regular expressions over normalised text: lower case, words parted by single blanks, punctuation gone. In
them THE is an optional article, VER an optional "version" or "v", LIC either spelling of licence, LATER the usual ending
for later versions. A match begins and ends at word borders. The label ``-`` marks what only looks like a licence: such
a match suppresses others and yields no label.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    """``keywords`` are words that every match has; ``base`` rules are reported at all their places, whatever overlaps."""

    label: str
    kind: str
    keywords: tuple[str, ...]
    pattern: str
    base: bool = False


#: Kinds of signatures from the weakest to the strongest, each with the confidence that a match deserves.
KINDS = {"hint": 0.4, "name": 0.7, "version": 0.9, "identifier": 0.95, "notice": 0.99, "lookalike": 0.0}

BASE = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)

LOOKALIKE = r"""
-: license: drivers?(?: s)? license
-: driving licence: driving licence
-: license: license plates?
-: license: (?:fishing|hunting) license
-: marriage license: marriage license
-: liquor license: liquor license
-: pilot license: pilot(?: s)? license
-: poetic license: poetic license
-: artistic license expression: artistic license (?:in|of) (?:its|his|her|their) expression
-: business license: business license (?:fee|number|application)
-: license: (?:medical|nursing|teaching) license
-: license kill: license to kill
-: licence: (?:television|tv) licence
-: software license: software license keys?
-: license manager: license manager
-: license: license servers?
-: expired license: (?:your|the) license (?:has|is) expired
-: not apache license: not (?:released |licensed )?under THEapache license
-: not mit license: not (?:released |licensed )?under THEmit license
-: not gnu license: not (?:released |licensed )?under THEgnu (?:lesser |affero )?general public license
-: massachusetts technology: massachusetts institute of technology admissions?
-: bsd: bsd sockets?
-: apache: apache helicopters?
-: apache: apache (?:http |web )?servers?
"""

NOTICE = r"""
mit: permission granted copy software charge: permission is hereby granted free of charge to any person obtaining a copy of this software(?: and associated documentation files)?
mit: software provided warranty noninfringement: the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
mit: copyright permission notice substantial: the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software
mit-0: permission granted charge obligation: permission is hereby granted free of charge to any person obtaining a copy (?:\S+ ){1,80}without restriction without any obligation
isc: permission copy modify distribute fee notice: permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
0bsd: permission copy modify distribute fee granted: permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
bsd: redistribution source binary forms permitted: redistribution and use in source and binary forms with or without modification are permitted
bsd: redistributions source retain copyright: redistributions of source code must retain the above copyright notice
bsd: redistributions binary reproduce copyright: redistributions in binary form must reproduce the above copyright notice
bsd-3-clause: neither endorse promote products: neither the names? of (?:\S+ ){1,20}may be used to endorse or promote products
bsd-4-clause: advertising materials mentioning: all advertising materials mentioning features or use of this software must display the following acknowledge?ment
apache-2.0: licensed apache 2 0 compliance: licensed under the apache license version 2 0 the license you may not use (?:this file|\S+) except in compliance with the license
apache-2.0: apache licenses 2 0: http www apache org licenses license 2 0
apache-1.1: apache software foundation developed: this product includes software developed by the apache software foundation
gpl-2.0-or-later: redistribute gnu general public 2: you can redistribute it and or modify it under the terms of the gnu general public LIC as published by the free software foundation either version 2 of the LIC or at your option any later version
gpl-3.0-or-later: redistribute gnu general public 3: you can redistribute it and or modify it under the terms of the gnu general public LIC as published by the free software foundation either version 3 of the LIC or at your option any later version
gpl-2.0-only: redistribute gnu general public 2: you can redistribute it and or modify it under the terms of the gnu general public LIC(?: version 2)? as published by the free software foundation version 2(?: of the LIC)?
gpl: redistribute gnu general public: you can redistribute it and or modify it under the terms of the gnu general public LIC
lgpl-2.1-or-later: redistribute gnu lesser 2 1: you can redistribute it and or modify it under the terms of the gnu lesser general public LIC as published by the free software foundation either version 2 1 of the LIC or at your option any later version
lgpl-3.0-or-later: redistribute gnu lesser 3: you can redistribute it and or modify it under the terms of the gnu lesser general public LIC as published by the free software foundation either version 3 of the LIC or at your option any later version
lgpl: redistribute gnu lesser: you can redistribute it and or modify it under the terms of the gnu lesser general public LIC
lgpl-2.0-or-later: redistribute gnu library 2: you can redistribute it and or modify it under the terms of the gnu library general public LIC as published by the free software foundation either version 2 of the LIC or at your option any later version
agpl-3.0-or-later: redistribute gnu affero 3: you can redistribute it and or modify it under the terms of the gnu affero general public LIC as published by the free software foundation either version 3 of the LIC or at your option any later version
agpl: redistribute gnu affero: you can redistribute it and or modify it under the terms of the gnu affero general public LIC
gpl: warranty merchantability gnu general public details: without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public LIC for more details
gfdl: permission document gnu free documentation: permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation LIC
mpl-2.0: subject mozilla public 0: this source code form is subject to the terms of the mozilla public LIC (?:version 2|v ?2) 0
mpl-2.0: copy mpl obtain mozilla 2: if a copy of the mpl was not distributed with this file you can obtain one at https? (?:www )?mozilla org mpl 2 0
mpl-1.1: contents subject mozilla public 1 1: the contents of this file are subject to the mozilla public LIC version 1 1
epl-1.0: accompanying eclipse public 0: this program and the accompanying materials are made available under the terms of the eclipse public LIC (?:version 1|v ?1|1) 0
epl-2.0: accompanying eclipse public 0: this program and the accompanying materials are made available under the terms of the eclipse public LIC (?:version 2|v ?2|2) 0
cddl: contents subject common development distribution: the contents of this file are subject to the terms of the common development and distribution LIC
unlicense: free unencumbered public domain: this is free and unencumbered software released into the public domain
wtfpl: just fuck want: you just do what the fuck you want to
wtfpl: fuck want public license: do what the fuck you want to public license
zlib: software provided implied held damages: this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages
zlib: origin misrepresented claim: the origin of this software must not be misrepresented you must not claim that you wrote the original software
bsl-1.0: permission charge organization accompanying: permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
beerware: beer worth stuff: if we meet some day and you think this stuff is worth it you can buy me a beer
json: software shall good evil: the software shall be used for good not evil
postgresql: permission copy modify fee agreement written: permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
ncsa: deal restriction illinois: developed by (?:\S+ ){1,20}university of illinois (?:\S+ ){1,80}deal with the software without restriction
cc-by-4.0: work licensed creative attribution 4 0 international: this work is licensed under THEcreative commons attribution 4 0 international license
cc-by-sa-4.0: work licensed creative sharealike 4 0: this work is licensed under THEcreative commons attribution sharealike 4 0 international license
cc-by-nc-4.0: work licensed creative noncommercial 4 0: this work is licensed under THEcreative commons attribution noncommercial 4 0 international license
cc-by-nd-4.0: work licensed creative noderivatives 4 0: this work is licensed under THEcreative commons attribution noderivatives 4 0 international license
cc-by-nc-sa-4.0: work licensed creative noncommercial sharealike 4 0: this work is licensed under THEcreative commons attribution noncommercial sharealike 4 0 international license
cc-by-nc-nd-4.0: work licensed creative noncommercial noderivatives 4 0: this work is licensed under THEcreative commons attribution noncommercial noderivatives 4 0 international license
cc0-1.0: person associated work deed dedicated: the person who associated a work with this deed has dedicated the work to the public domain
openssl: product includes openssl project toolkit: this product includes software developed by the openssl project for use in the openssl toolkit
sspl-1.0: functionality third parties service: if you make the functionality of the program or a modified version available to third parties as a service
busl-1.1: licensor grants production: the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
elastic-2.0: provide software hosted managed service: you may not provide the software to third parties as a hosted or managed service
ofl-1.1: font software licensed sil open 1 1: this font software is licensed under the sil open font license version 1 1
proprietary: unauthorized strictly prohibited: unauthorized (?:copying|use|reproduction)(?: or distribution)? of this (?:file|software|document)(?: via any medium)? is strictly prohibited(?: (?:software )?proprietary and confidential)?
proprietary: part reproduced: no part of this (?:publication|book|work|document) may be reproduced(?: stored| distributed| or transmitted)?
proprietary: contains proprietary information: this (?:document|file|message|software) contains (?:confidential and |trade secrets and )?proprietary (?:and confidential )?information
"""

IDENTIFIER = r"""
apache-2.0: spdx apache 2 0: spdx license identifier apache 2 0
apache-1.1: spdx apache 1 1: spdx license identifier apache 1 1
mit: spdx mit: spdx license identifier mit
mit-0: spdx mit 0: spdx license identifier mit 0
bsd-2-clause: spdx bsd 2 clause: spdx license identifier bsd 2 clause
bsd-3-clause: spdx bsd 3 clause: spdx license identifier bsd 3 clause
bsd-4-clause: spdx bsd 4 clause: spdx license identifier bsd 4 clause
0bsd: spdx 0bsd: spdx license identifier 0bsd
gpl-2.0-only: spdx gpl 2 0: spdx license identifier gpl 2 0(?: only)?
gpl-2.0-or-later: spdx gpl 2 0 later: spdx license identifier gpl 2 0 or later
gpl-3.0-only: spdx gpl 3 0: spdx license identifier gpl 3 0(?: only)?
gpl-3.0-or-later: spdx gpl 3 0 later: spdx license identifier gpl 3 0 or later
lgpl-2.1-only: spdx lgpl 2 1: spdx license identifier lgpl 2 1(?: only)?
lgpl-2.1-or-later: spdx lgpl 2 1 later: spdx license identifier lgpl 2 1 or later
lgpl-3.0-only: spdx lgpl 3 0: spdx license identifier lgpl 3 0(?: only)?
lgpl-3.0-or-later: spdx lgpl 3 0 later: spdx license identifier lgpl 3 0 or later
agpl-3.0-only: spdx agpl 3 0: spdx license identifier agpl 3 0(?: only)?
agpl-3.0-or-later: spdx agpl 3 0 later: spdx license identifier agpl 3 0 or later
mpl-1.1: spdx mpl 1 1: spdx license identifier mpl 1 1
mpl-2.0: spdx mpl 2 0: spdx license identifier mpl 2 0
epl-1.0: spdx epl 1 0: spdx license identifier epl 1 0
epl-2.0: spdx epl 2 0: spdx license identifier epl 2 0
cddl-1.0: spdx cddl 1 0: spdx license identifier cddl 1 0
cddl-1.1: spdx cddl 1 1: spdx license identifier cddl 1 1
isc: spdx isc: spdx license identifier isc
zlib: spdx zlib: spdx license identifier zlib
unlicense: spdx unlicense: spdx license identifier unlicense
wtfpl: spdx wtfpl: spdx license identifier wtfpl
cc0-1.0: spdx cc0 1 0: spdx license identifier cc0 1 0
cc-by-4.0: spdx cc by 4 0: spdx license identifier cc by 4 0
cc-by-sa-4.0: spdx cc by sa 4 0: spdx license identifier cc by sa 4 0
bsl-1.0: spdx bsl 1 0: spdx license identifier bsl 1 0
busl-1.1: spdx busl 1 1: spdx license identifier busl 1 1
sspl-1.0: spdx sspl 1 0: spdx license identifier sspl 1 0
elastic-2.0: spdx elastic 2 0: spdx license identifier elastic 2 0
artistic-1.0: spdx artistic 1 0: spdx license identifier artistic 1 0
artistic-2.0: spdx artistic 2 0: spdx license identifier artistic 2 0
ofl-1.1: spdx ofl 1 1: spdx license identifier ofl 1 1
psf-2.0: spdx psf 2 0: spdx license identifier psf 2 0
upl-1.0: spdx upl 1 0: spdx license identifier upl 1 0
eupl-1.2: spdx eupl 1 2: spdx license identifier eupl 1 2
mulan-psl-2.0: spdx mulanpsl 2 0: spdx license identifier mulanpsl 2 0
ms-pl: spdx ms pl: spdx license identifier ms pl
unknown-spdx: spdx identifier: spdx license identifier \S+
apache-2.0: approved apache osi: license osi approved apache software license
bsd: approved bsd osi: license osi approved bsd license
mit: approved mit osi: license osi approved mit license
gpl: osi gnu general public: license osi approved gnu general public license(?: v[23](?: gplv[23])?)?
lgpl: osi gnu lesser: license osi approved gnu lesser general public license(?: v[23](?: lgplv[23])?)?
mpl-2.0: osi mozilla 2 0: license osi approved mozilla public license 2 0(?: mpl 2 0)?
"""

VERSION = r"""
apache-1.0: apache 1 0: apache(?: software)? LIC VER1 0
apache-1.1: apache 1 1: apache(?: software)? LIC VER1 1
apache-2.0: apache 2 0: apache(?: software)? LIC VER2 0
apache-2.0: apache 2: apache(?: software)? LIC VER2
apache-2.0: apache 2 0: apache 2 0(?: LIC)?
apache-2.0: apache v2: apache(?: LIC)? v2(?: 0)?
gpl-1.0: gnu general public 1: gnu general public LIC VER1(?: 0)?
gpl-2.0: gnu general public 2: gnu general public LIC VER2(?: 0)?
gpl-3.0: gnu general public 3: gnu general public LIC VER3(?: 0)?
gpl-2.0-or-later: gnu general public 2 later: gnu general public LIC VER2(?: 0)?LATER
gpl-3.0-or-later: gnu general public 3 later: gnu general public LIC VER3(?: 0)?LATER
gpl-2.0: gpl 2: gpl VER2(?: 0)?
gpl-3.0: gpl 3: gpl VER3(?: 0)?
gpl-2.0-or-later: gpl 2 later: gpl VER2(?: 0)?LATER
gpl-3.0-or-later: gpl 3 later: gpl VER3(?: 0)?LATER
gpl-2.0: gplv2: gplv2(?: 0)?
gpl-3.0: gplv3: gplv3(?: 0)?
gpl-2.0-or-later: gplv2 later: gplv2(?: 0)?LATER
gpl-3.0-or-later: gplv3 later: gplv3(?: 0)?LATER
lgpl-2.0: gnu library public 2: gnu library general public LIC VER2(?: 0)?
lgpl-2.1: gnu lesser public 2 1: gnu lesser general public LIC VER2 1
lgpl-3.0: gnu lesser public 3: gnu lesser general public LIC VER3(?: 0)?
lgpl-2.1-or-later: gnu lesser public 2 1 later: gnu lesser general public LIC VER2 1LATER
lgpl-3.0-or-later: gnu lesser public 3 later: gnu lesser general public LIC VER3(?: 0)?LATER
lgpl-2.1: lgpl 2 1: lgpl VER2 1
lgpl-3.0: lgpl 3: lgpl VER3(?: 0)?
lgpl-2.1: lgplv2 1: lgplv2 1
lgpl-3.0: lgplv3: lgplv3(?: 0)?
agpl-1.0: affero public 1: (?:gnu )?affero general public LIC VER1(?: 0)?
agpl-3.0: affero public 3: (?:gnu )?affero general public LIC VER3(?: 0)?
agpl-3.0-or-later: affero public 3 later: (?:gnu )?affero general public LIC VER3(?: 0)?LATER
agpl-3.0: agpl 3: agpl VER3(?: 0)?
agpl-3.0: agplv3: agplv3(?: 0)?
gfdl-1.1: gnu free documentation 1 1: gnu free documentation LIC VER1 1
gfdl-1.2: gnu free documentation 1 2: gnu free documentation LIC VER1 2
gfdl-1.3: gnu free documentation 1 3: gnu free documentation LIC VER1 3
cc-by-1.0: cc by 1 0: cc by 1 0
cc-by-2.0: cc by 2 0: cc by 2 0
cc-by-2.5: cc by 2 5: cc by 2 5
cc-by-3.0: cc by 3 0: cc by 3 0
cc-by-4.0: cc by 4 0: cc by 4 0
cc-by-sa-2.0: cc by sa 2 0: cc by sa 2 0
cc-by-sa-2.5: cc by sa 2 5: cc by sa 2 5
cc-by-sa-3.0: cc by sa 3 0: cc by sa 3 0
cc-by-sa-4.0: cc by sa 4 0: cc by sa 4 0
cc-by-nc-2.0: cc by nc 2 0: cc by nc 2 0
cc-by-nc-3.0: cc by nc 3 0: cc by nc 3 0
cc-by-nc-4.0: cc by nc 4 0: cc by nc 4 0
cc-by-nd-3.0: cc by nd 3 0: cc by nd 3 0
cc-by-nd-4.0: cc by nd 4 0: cc by nd 4 0
cc-by-nc-sa-2.0: cc by nc sa 2 0: cc by nc sa 2 0
cc-by-nc-sa-3.0: cc by nc sa 3 0: cc by nc sa 3 0
cc-by-nc-sa-4.0: cc by nc sa 4 0: cc by nc sa 4 0
cc-by-nc-nd-3.0: cc by nc nd 3 0: cc by nc nd 3 0
cc-by-nc-nd-4.0: cc by nc nd 4 0: cc by nc nd 4 0
cc-by-3.0: creative commons attribution 3 0: creative commons attribution 3 0(?: unported)?(?: LIC)?
cc-by-4.0: creative commons attribution 4 0: creative commons attribution 4 0(?: international)?(?: LIC)?
cc-by-sa-3.0: creative commons attribution 3 0: creative commons attribution share ?alike 3 0(?: unported)?(?: LIC)?
cc-by-sa-4.0: creative commons attribution 4 0: creative commons attribution share ?alike 4 0(?: international)?(?: LIC)?
cc-by-nc-4.0: creative commons attribution 4 0: creative commons attribution non ?commercial 4 0(?: international)?(?: LIC)?
cc-by-nc-sa-4.0: creative commons attribution 4 0: creative commons attribution non ?commercial share ?alike 4 0(?: international)?(?: LIC)?
cc-by-nc-nd-4.0: creative commons attribution 4 0: creative commons attribution non ?commercial no ?deriv(?:ative)?s 4 0(?: international)?(?: LIC)?
cc-by-nd-4.0: creative commons attribution 4 0: creative commons attribution no ?deriv(?:ative)?s 4 0(?: international)?(?: LIC)?
cc-by-4.0: creativecommons licenses by 4 0: creativecommons org licenses by 4 0
cc-by-3.0: creativecommons licenses by 3 0: creativecommons org licenses by 3 0
cc-by-sa-3.0: creativecommons licenses by sa 3 0: creativecommons org licenses by sa 3 0
cc-by-sa-4.0: creativecommons licenses by sa 4 0: creativecommons org licenses by sa 4 0
cc-by-nc-sa-4.0: creativecommons licenses by nc sa 4 0: creativecommons org licenses by nc sa 4 0
cc0-1.0: cc0 1 0: cc0 1 0(?: universal)?
cc0-1.0: creativecommons publicdomain zero 1 0: creativecommons org publicdomain zero 1 0
mpl-1.0: mozilla public 1 0: mozilla public LIC VER1 0
mpl-1.1: mozilla public 1 1: mozilla public LIC VER1 1
mpl-2.0: mozilla public 2 0: mozilla public LIC VER2 0
mpl-2.0: mpl 2 0: mpl VER2 0
epl-1.0: eclipse public 1 0: eclipse public LIC VER1 0
epl-2.0: eclipse public 2 0: eclipse public LIC VER2 0
cddl-1.0: common development distribution 1 0: common development and distribution LIC VER1 0
cddl-1.1: common development distribution 1 1: common development and distribution LIC VER1 1
bsd-2-clause: bsd 2 clause: bsd 2 clause(?: LIC)?
bsd-3-clause: bsd 3 clause: bsd 3 clause(?: LIC)?
bsd-4-clause: bsd 4 clause: bsd 4 clause(?: LIC)?
bsd-2-clause: 2 clause bsd: 2 clause bsd(?: LIC)?
bsd-3-clause: 3 clause bsd: 3 clause bsd(?: LIC)?
bsd-2-clause: two clause bsd: two clause bsd(?: LIC)?
bsd-3-clause: three clause bsd: three clause bsd(?: LIC)?
bsd-2-clause: simplified bsd: simplified bsd(?: LIC)?
bsd-3-clause: bsd: (?:modified|revised|new) bsd LIC|modified bsd
0bsd: zero clause bsd: zero clause bsd(?: LIC)?
artistic-1.0: artistic 1 0: artistic LIC VER1 0
artistic-2.0: artistic 2 0: artistic LIC VER2 0
bsl-1.0: boost software 1 0: boost software LIC VER1 0
busl-1.1: business source 1 1: business source LIC VER1 1
sspl-1.0: server side public 1: server side public LIC VER1(?: 0)?
elastic-2.0: elastic 2 0: elastic LIC VER2 0
eupl-1.1: european union public 1 1: european union public LIC VER1 1
eupl-1.2: european union public 1 2: european union public LIC VER1 2
afl-3.0: academic free 3 0: academic free LIC VER3 0
osl-3.0: open software 3 0: open software LIC VER3 0
ofl-1.1: open font 1 1: (?:sil )?open font LIC VER1 1
odbl-1.0: open database 1 0: open database LIC VER1 0
ogl-uk-3.0: open government 3 0: open government LIC VER3 0
lppl-1.3c: latex project public 1 3c: latex project public LIC VER1 3c
python-2.0: python 2 0: python LIC VER2 0
php-3.01: php 3 01: php LIC VER3 01
zpl-2.1: zope public 2 1: zope public LIC VER2 1
cecill-2.1: cecill 2 1: cecill(?: free software)?(?: LIC)? (?:agreement )?VER2 1
cpl-1.0: common public 1 0: common public LIC VER1 0
ipl-1.0: ibm public 1 0: ibm public LIC VER1 0
upl-1.0: universal permissive 1 0: universal permissive LIC VER1 0
llama-2: llama 2 community: llama 2 community LIC(?: agreement)?
llama-3: llama 3 community: (?:meta )?llama 3 community LIC(?: agreement)?
openrail: creativeml m: creativeml open ?rail(?: \S)? m
"""

NAME = r"""
lgpl: gnu lesser general public: gnu lesser general public LIC
lgpl: gnu library general public: gnu library general public LIC
agpl: affero general public: (?:gnu )?affero general public LIC
gfdl: gnu free documentation: gnu free documentation LIC
gpl: gpl: gnu gpl|gpl
lgpl: lgpl: (?:gnu )?lgpl
agpl: agpl: (?:gnu )?agpl
gpl: gnu public: gnu public LIC
apache: apache software: apache software LIC
mit: x11: (?:mit x11|x11 mit|x11 LIC)
mit: expat: expat LIC
mit: mit licensed: mit licensed
bsd: bsd: (?:the )?bsd LIC|bsd style LIC|bsd licensed
isc: isc: isc LIC
zlib: zlib: zlib(?: libpng)? LIC
libpng: libpng: libpng LIC
mpl: mozilla public: mozilla public LIC
epl: eclipse public: eclipse public LIC
cddl: common development distribution: common development and distribution LIC
cc-by-sa: cc by sa: cc by sa
cc-by-nc: cc by nc: cc by nc
cc-by-nd: cc by nd: cc by nd
cc-by-nc-sa: cc by nc sa: cc by nc sa
cc-by-nc-nd: cc by nc nd: cc by nc nd
cc-by: creative commons attribution: creative commons attribution(?: LIC)?
cc-by-sa: creative commons attribution: creative commons attribution share ?alike(?: LIC)?
cc0-1.0: cc0: cc0(?: LIC)?
creative-commons: creative commons: creative commons(?: LIC)?
public-domain: public domain: (?:released|placed|dedicated|is) (?:in|into|to) the public domain
public-domain: public domain: public domain (?:dedication|work|software)
unlicense: unlicense: the unlicense
wtfpl: wtfpl: wtfpl
artistic: artistic: THEartistic LIC
perl: perl same terms: (?:under )?the same terms as perl(?: itself)?
python: python software foundation: python software foundation LIC
ruby: ruby: ruby LIC
php: php: php LIC
postgresql: postgresql: postgresql LIC
openssl: openssl: openssl LIC
curl: curl: curl LIC
ncsa: illinois ncsa: university of illinois ncsa(?: open source)?(?: LIC)?
unicode: unicode: unicode(?: inc)? LIC(?: agreement)?
w3c: w3c software: w3c software(?: notice and)? LIC
eupl: european union public: european union public LIC
cecill: cecill: cecill(?: LIC)?
ms-pl: microsoft public: microsoft public LIC
ms-rl: microsoft reciprocal: microsoft reciprocal LIC
ofl: open font: (?:sil )?open font LIC
odbl: open database: open database LIC
odbl: odbl: odbl
odc-by: open data commons attribution: open data commons attribution LIC
pddl: public domain dedication: open data commons public domain dedication and LIC
ogl-uk: open government: open government LIC
cdla: community data agreement: community data LIC agreement
openrail: openrail: (?:bigscience |creativeml )?openrail(?: m)?(?: LIC)?
llama: llama community: llama(?: \S+)? community LIC
bsl-1.0: boost software: boost software LIC
busl: business source: business source LIC
sspl: sspl: sspl
sspl: server side public: server side public LIC
elastic: elastic: elastic LIC
commons-clause: commons clause: commons clause
lppl: latex project public: latex project public LIC
sleepycat: sleepycat: sleepycat LIC
qpl: q public: q public LIC
vim: vim: vim LIC
beerware: beerware: beerware(?: LIC)?
beerware: beer ware: beer ware LIC
zpl: zope public: zope public LIC
eiffel: eiffel forum: eiffel forum LIC
intel: intel open: intel open source LIC
nokia: nokia open: nokia open source LIC
npl: netscape public: netscape public LIC
rpl: reciprocal public: reciprocal public LIC
spl: sun public: sun public LIC
watcom: sybase watcom: sybase open watcom public LIC
afl: academic free: academic free LIC
osl: open software: open software LIC
upl: universal permissive: universal permissive LIC
mulan-psl: mulan permissive: mulan permissive software LIC
hippocratic: hippocratic: hippocratic LIC
parity: parity public: parity public LIC
polyform: polyform: polyform (?:noncommercial|small business|shield|strict|internal use)(?: LIC)?
fair-source: fair source: fair source LIC
prosperity: prosperity public: prosperity public LIC
non-commercial: non commercial only: for (?:personal and )?non commercial (?:use|purposes|research)(?: purposes)? only
non-commercial: noncommercial only: for (?:personal and )?noncommercial (?:use|purposes|research)(?: purposes)? only
research-only: research only: for (?:academic )?research (?:use|purposes) only
personal-use: personal only: for (?:your )?personal use only
freeware: freeware: (?:this (?:program|software) is |released as )?freeware
shareware: shareware: (?:this (?:program|software) is |released as )?shareware
proprietary: proprietary: proprietary LIC|proprietary and confidential
commercial: commercial: commercial LIC(?: agreement)?
eula: end user agreement: end user LIC agreement
dual-license: licensed: dual(?:ly)? licensed
"""

HINT = r"""
copyright: copyright: copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d)*
copyright: copyright: copyright (?:by|holders?|owners?|notice)
all-rights-reserved: rights reserved: all rights reserved
some-rights-reserved: rights reserved: some rights reserved
unknown-license: licensed: (?:is |are )?licensed under(?: the)?(?: \S+){0,2}
unknown-license: under: (?:released|distributed|published|available|provided) under (?:the )?(?:\S+ ){0,4}LIC
unknown-license: see: see (?:the )?LIC(?: file)?(?: for (?:more )?details)?
unknown-license: terms: (?:under|subject to) the terms of (?:the|this) (?:\S+ ){0,4}(?:LIC|agreement)
unknown-license: terms conditions: terms and conditions (?:of use|apply)
unknown-license: permission: (?:used|reprinted|reproduced) (?:with|by) permission
unknown-license: open: open source LIC
unknown-license: royalty free: royalty free(?: LIC)?
"""

_WORDS = (
    ("THE", "(?:the )?"), ("VER", "(?:version |v )?"), ("LIC", "licen[sc]e"),
    ("LATER", " or (?:at your option )?(?:any )?later(?: versions?)?"),
)


def _section(kind: str, lines: str) -> list[Rule]:
    rules = []
    for line in lines.strip().splitlines():
        label, keywords, pattern = line.split(": ", 2)
        for short, full in _WORDS:
            pattern = pattern.replace(short, full)
        literal = set(re.findall(r"[a-z0-9]+", keywords))
        rules.append(Rule(label, kind, tuple(sorted(literal)), pattern))
    return rules


RULES: tuple[Rule, ...] = (
    *(Rule(label, "name", tuple(phrase.split()), phrase, base=True) for label, phrase in BASE),
    *_section("lookalike", LOOKALIKE),
    *_section("notice", NOTICE),
    *_section("identifier", IDENTIFIER),
    *_section("version", VERSION),
    *_section("name", NAME),
    *_section("hint", HINT),
)
