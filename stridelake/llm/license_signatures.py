"""Licence signatures, written for texts in lower case whose words are parted by single blanks.

A line is ``label ; priority ; keyword ; pattern``. The pattern runs only on texts that hold the
keyword, which every match of it contains. Between words of a pattern stands a blank; ``~`` stands for up to three words of any kind.
"""

from __future__ import annotations

import re
from typing import NamedTuple

#: SPDX identifiers: each makes the rule "spdx license identifier <id>" at the highest priority.
IDENTIFIERS = """
0BSD AAL AFL-1.1 AFL-1.2 AFL-2.0 AFL-2.1 AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later AGPL-3.0 Apache-1.0 Apache-1.1 Apache-2.0
APSL-2.0 Artistic-1.0 Artistic-2.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause
BSL-1.0 BUSL-1.1 CAL-1.0 CATOSL-1.1 CC-BY-1.0 CC-BY-2.0 CC-BY-2.5 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-2.0 CC-BY-NC-3.0 CC-BY-NC-4.0
CC-BY-NC-ND-3.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-3.0 CC-BY-NC-SA-4.0 CC-BY-ND-3.0 CC-BY-ND-4.0 CC-BY-SA-2.0 CC-BY-SA-3.0 CC-BY-SA-4.0
CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 CECILL-B CECILL-C CPAL-1.0 CPL-1.0 ECL-2.0 EFL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2
FSFAP GFDL-1.1 GFDL-1.2 GFDL-1.3 GPL-1.0 GPL-2.0-only GPL-2.0-or-later GPL-2.0 GPL-3.0-only GPL-3.0-or-later GPL-3.0 HPND IJG
Info-ZIP Intel IPL-1.0 ISC LGPL-2.0 LGPL-2.1-only LGPL-2.1-or-later LGPL-2.1 LGPL-3.0-only LGPL-3.0-or-later LGPL-3.0 Libpng LPL-1.02
LPPL-1.3c MIT MIT-0 MPL-1.0 MPL-1.1 MPL-2.0 MS-PL MS-RL NCSA NPL-1.1 ODbL-1.0 ODC-By-1.0 OFL-1.0 OFL-1.1 OLDAP-2.8 OpenSSL OSL-3.0
PDDL-1.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 RPL-1.5 Ruby SISSL Sleepycat SSPL-1.0 TCL Unicode-3.0 Unlicense UPL-1.0 Vim
W3C WTFPL X11 Xnet XSkat Zend-2.0 Zlib zlib-acknowledgement ZPL-2.1
"""

SIGNATURES = r"""
# grants and conditions
mit ; 90 ; free of charge ; permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit ; 80 ; free of charge ; permission is hereby granted free of charge to any person obtaining a copy
mit ; 75 ; sublicense ; to use copy modify merge publish distribute sublicense and or sell copies
mit ; 70 ; permission notice ; the above copyright notice and this permission notice shall be included in all copies
isc ; 90 ; with or without fee ; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
hpnd ; 85 ; and without fee ; permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted
bsd ; 85 ; source and binary ; redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd ; 75 ; source and binary ; redistribution and use in source and binary forms
bsd ; 70 ; redistributions ; redistributions of source code must retain the above copyright notice
bsd ; 70 ; redistributions ; redistributions in binary form must reproduce the above copyright notice
bsd-3-clause ; 88 ; endorse ; neither the name of ~ nor the names of its contributors may be used to endorse or promote products
bsd-3-clause ; 80 ; endorse ; may be used to endorse or promote products derived from this software
bsd-4-clause ; 88 ; advertising ; all advertising materials mentioning features or use of this software must display
apache-2.0 ; 90 ; apache ; licensed under the apache license version 2 0
apache-2.0 ; 85 ; apache org ; (?:https? )?(?:www )?apache org licenses license 2 0
apache ; 70 ; except in compliance ; you may not use this file except in compliance with the license
apache-1.1 ; 88 ; apache ; this product includes software developed by the apache software foundation
gpl ; 80 ; general public ; under the terms of the gnu general public license
gpl-2.0-or-later ; 92 ; general public ; gnu general public license as published by the free software foundation either version 2 of the license or (?:at your option )?any later version
gpl-3.0-or-later ; 92 ; general public ; gnu general public license as published by the free software foundation either version 3 of the license or (?:at your option )?any later version
gpl-2.0 ; 88 ; general public ; gnu general public license (?:version |v ?)2
gpl-3.0 ; 88 ; general public ; gnu general public license (?:version |v ?)3
gpl-1.0 ; 88 ; general public ; gnu general public license (?:version |v ?)1
gpl ; 75 ; free software ; this program is free software you can redistribute it and or modify
gpl ; 60 ; general public ; you should have received a copy of the gnu general public license
lgpl ; 82 ; lesser ; under the terms of the gnu lesser general public license
lgpl-2.1 ; 90 ; lesser ; gnu lesser general public license (?:version |v ?)2 1
lgpl-3.0 ; 90 ; lesser ; gnu lesser general public license (?:version |v ?)3
lgpl-2.0 ; 90 ; library ; gnu library general public license (?:version |v ?)2
lgpl ; 62 ; lesser ; you should have received a copy of the gnu lesser general public license
agpl ; 82 ; affero ; under the terms of the gnu affero general public license
agpl-3.0 ; 90 ; affero ; gnu affero general public license (?:version |v ?)3
gfdl ; 82 ; documentation license ; under the terms of the gnu free documentation license
gfdl-1.3 ; 90 ; documentation license ; gnu free documentation license version 1 3
gfdl-1.2 ; 90 ; documentation license ; gnu free documentation license version 1 2
gfdl ; 70 ; invariant ; with no invariant sections no front cover texts and no back cover texts
mpl-2.0 ; 92 ; mozilla ; this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1 ; 92 ; mozilla ; the contents of this file are subject to the mozilla public license version 1 1
mpl ; 75 ; mozilla ; subject to the (?:terms of the )?mozilla public license
epl-2.0 ; 90 ; eclipse ; made available under the terms of the eclipse public license (?:version |v ?)2 0
epl-1.0 ; 90 ; eclipse ; made available under the terms of the eclipse public license (?:version |v ?)1 0
epl ; 75 ; eclipse ; under the terms of the eclipse public license
cddl ; 80 ; development and distribution ; subject to the terms of the common development and distribution license
boost ; 90 ; boost ; distributed under the boost software license version 1 0
boost ; 80 ; organization obtaining ; to any person or organization obtaining a copy of the software and accompanying documentation
zlib ; 88 ; as is ; this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib ; 75 ; plainly marked ; altered source versions must be plainly marked as such
unlicense ; 92 ; unencumbered ; this is free and unencumbered software released into the public domain
wtfpl ; 85 ; what the ; do what the ~ you want to public license
cc0-1.0 ; 88 ; waived ; (?:has )?waived all copyright and related or neighboring rights
cc0-1.0 ; 85 ; dedicat ; dedicate[sd]? ~ to the public domain
public-domain ; 80 ; public domain ; (?:released|placed|put) (?:in|into) the public domain
public-domain ; 70 ; public domain ; this (?:work|file|text|software|book|page|image) is (?:in|part of) the public domain
public-domain ; 60 ; known copyright ; no known copyright
cc-by-4.0 ; 90 ; creative commons ; (?:licensed|released|available|published) under (?:a|the) creative commons attribution 4 0 international license
cc-by-sa-4.0 ; 90 ; creative commons ; (?:licensed|released|available|published) under (?:a|the) creative commons attribution share ?alike 4 0 international license
cc-by-nc-4.0 ; 90 ; creative commons ; (?:licensed|released|available|published) under (?:a|the) creative commons attribution non ?commercial 4 0 international license
cc-by-nd-4.0 ; 90 ; creative commons ; (?:licensed|released|available|published) under (?:a|the) creative commons attribution no ?deriv(?:ative)?s 4 0 international license
cc-by-nc-sa-4.0 ; 90 ; creative commons ; (?:licensed|released|available|published) under (?:a|the) creative commons attribution non ?commercial share ?alike 4 0 international license
cc-by-nc-nd-4.0 ; 90 ; creative commons ; (?:licensed|released|available|published) under (?:a|the) creative commons attribution non ?commercial no ?deriv(?:ative)?s 4 0 international license
cc-by-3.0 ; 88 ; creative commons ; creative commons attribution 3 0 (?:unported|united states|us)? ?license
cc-by-sa-3.0 ; 88 ; creative commons ; creative commons attribution share ?alike 3 0 (?:unported|united states|us)? ?license
ofl-1.1 ; 90 ; open font ; (?:this font software is )?licensed under the sil open font license version 1 1
odbl ; 85 ; open database ; made available under the open database license
odc-by ; 85 ; open data commons ; made available under the open data commons attribution license
pddl ; 85 ; public domain dedication ; made available under the public domain dedication and license
artistic-2.0 ; 85 ; artistic ; under the terms of the artistic license 2 0
perl ; 80 ; perl itself ; under the same terms as perl itself
psf ; 85 ; python software ; python software foundation license version 2
postgresql ; 85 ; university of california ; in no event shall the university of california be liable to any party
ncsa ; 85 ; illinois ; university of illinois ncsa open source license
openssl ; 85 ; openssl ; this product includes software developed by the openssl project
sleepycat ; 80 ; complete source code ; redistributions in any form must be accompanied by information on how to obtain complete source code
json ; 85 ; good not evil ; the software shall be used for good not evil
beerware ; 85 ; beer ; (?:you can )?buy me a beer in return
eupl-1.2 ; 88 ; eupl ; licensed under the eupl (?:version |v ?)?1 2
busl ; 85 ; business source ; business source license 1 1
sspl ; 85 ; server side public ; server side public license (?:version |v ?)1
commons-clause ; 85 ; commons clause ; commons clause license condition v1 0
elastic ; 85 ; elastic ; elastic license 2 0
ogl ; 85 ; open government ; contains public sector information licensed under the open government licence
# titles
mit ; 70 ; mit ; (?:the )?mit licen[sc]e
mit ; 72 ; mit ; (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of the )?mit(?: licen[sc]e)?
mit-0 ; 74 ; mit ; mit no attribution
x11 ; 70 ; x11 ; (?:the )?x11 licen[sc]e
isc ; 70 ; isc ; (?:the )?isc licen[sc]e
bsd ; 60 ; bsd ; (?:the )?bsd licen[sc]e
bsd ; 64 ; bsd ; (?:licensed|released|distributed|available) under (?:the |a )?bsd
bsd-2-clause ; 72 ; bsd ; (?:simplified|freebsd|2 clause|two clause) bsd(?: licen[sc]e)?
bsd-2-clause ; 72 ; bsd ; bsd (?:2|two) clause
bsd-3-clause ; 72 ; bsd ; (?:new|modified|revised|3 clause|three clause) bsd(?: licen[sc]e)?
bsd-3-clause ; 72 ; bsd ; bsd (?:3|three) clause
bsd-4-clause ; 72 ; bsd ; (?:original|old|4 clause) bsd(?: licen[sc]e)?
0bsd ; 72 ; bsd ; (?:zero clause bsd|0bsd)
apache-2.0 ; 74 ; apache ; apache(?: software)? licen[sc]e (?:version |v )?2(?: 0)?
apache-2.0 ; 72 ; apache ; apache 2 0
apache-1.1 ; 74 ; apache ; apache(?: software)? licen[sc]e (?:version |v )?1 1
apache ; 60 ; apache ; apache(?: software)? licen[sc]e
gpl ; 56 ; general public ; gnu general public licen[sc]e
gpl ; 54 ; gpl ; gnu gpl
gpl-2.0 ; 70 ; gpl ; gpl ?(?:version |v ?)?2(?: 0)?(?: only)?
gpl-2.0 ; 70 ; gplv2 ; gplv2(?: 0)?
gpl-2.0-or-later ; 74 ; gpl ; gpl ?(?:version |v ?)?2(?: 0)? or (?:later|any later version)
gpl-3.0 ; 70 ; gpl ; gpl ?(?:version |v ?)?3(?: 0)?(?: only)?
gpl-3.0 ; 70 ; gplv3 ; gplv3(?: 0)?
gpl-3.0-or-later ; 74 ; gpl ; gpl ?(?:version |v ?)?3(?: 0)? or (?:later|any later version)
lgpl ; 62 ; lesser ; gnu lesser general public licen[sc]e
lgpl ; 62 ; library ; gnu library general public licen[sc]e
lgpl-2.1 ; 72 ; lgpl ; lgpl ?(?:version |v ?)?2 1
lgpl-3.0 ; 72 ; lgpl ; lgpl ?(?:version |v ?)?3(?: 0)?
lgpl ; 50 ; lgpl ; lgpl
agpl ; 62 ; affero ; gnu affero general public licen[sc]e
agpl-3.0 ; 72 ; agpl ; agpl ?(?:version |v ?)?3(?: 0)?
agpl ; 50 ; agpl ; agpl
gfdl ; 62 ; free documentation ; gnu free documentation licen[sc]e
gfdl ; 50 ; gfdl ; gfdl
mpl-2.0 ; 72 ; mozilla ; mozilla public licen[sc]e (?:version |v ?)?2(?: 0)?
mpl-1.1 ; 72 ; mozilla ; mozilla public licen[sc]e (?:version |v ?)?1 1
mpl-1.0 ; 72 ; mozilla ; mozilla public licen[sc]e (?:version |v ?)?1 0
mpl ; 60 ; mozilla ; mozilla public licen[sc]e
mpl-2.0 ; 66 ; mpl ; mpl ?(?:v ?)?2 0
epl-2.0 ; 72 ; eclipse ; eclipse public licen[sc]e (?:version |v ?)?2(?: 0)?
epl-1.0 ; 72 ; eclipse ; eclipse public licen[sc]e (?:version |v ?)?1(?: 0)?
epl ; 60 ; eclipse ; eclipse public licen[sc]e
cpl-1.0 ; 66 ; common public ; common public licen[sc]e (?:version |v ?)?1 0
cddl-1.1 ; 72 ; cddl ; cddl (?:version |v ?)?1 1
cddl-1.0 ; 72 ; cddl ; cddl (?:version |v ?)?1 0
cddl ; 60 ; development and distribution ; common development and distribution licen[sc]e
boost ; 66 ; boost ; boost software licen[sc]e
zlib ; 66 ; zlib ; zlib(?: libpng)? licen[sc]e
libpng ; 66 ; libpng ; libpng licen[sc]e
unlicense ; 66 ; unlicense ; the unlicense
wtfpl ; 66 ; wtfpl ; wtfpl
cc0-1.0 ; 72 ; cc0 ; cc0(?: 1 0)?(?: universal)?
cc0-1.0 ; 72 ; creative commons ; creative commons (?:zero|cc0)
artistic-2.0 ; 70 ; artistic ; artistic licen[sc]e (?:version |v ?)?2(?: 0)?
artistic-1.0 ; 66 ; artistic ; artistic licen[sc]e
ofl-1.1 ; 68 ; open font ; (?:sil )?open font licen[sc]e
eupl ; 66 ; european union public ; european union public licen[sc]e
cecill ; 66 ; cecill ; cecill(?: b| c)?(?: v?2 1)? (?:free software )?licen[sc]e
osl-3.0 ; 68 ; open software license ; open software license (?:version |v ?)?3 0
afl-3.0 ; 68 ; academic free ; academic free license (?:version |v ?)?3 0
afl ; 62 ; academic free ; academic free licen[sc]e
ms-pl ; 68 ; microsoft ; microsoft public licen[sc]e
ms-rl ; 68 ; microsoft ; microsoft reciprocal licen[sc]e
php ; 66 ; php ; php licen[sc]e(?: version)?(?: 3 0?1)?
python ; 66 ; python ; python (?:software foundation )?licen[sc]e
ruby ; 60 ; ruby ; ruby licen[sc]e
vim ; 60 ; vim ; vim licen[sc]e
tcl ; 60 ; tcl ; tcl tk licen[sc]e
w3c ; 66 ; w3c ; w3c (?:software )?(?:notice and )?licen[sc]e
lppl ; 66 ; latex project ; latex project public licen[sc]e
qpl ; 66 ; q public ; q public licen[sc]e
upl ; 66 ; universal permissive ; universal permissive licen[sc]e
ecl-2.0 ; 66 ; educational community ; educational community licen[sc]e
ncsa ; 66 ; ncsa ; ncsa open source licen[sc]e
openssl ; 66 ; openssl ; openssl licen[sc]e
odbl ; 66 ; odbl ; odbl(?: v?1 0)?
odbl ; 66 ; open database ; open database licen[sc]e
pddl ; 66 ; pddl ; pddl(?: v?1 0)?
ogl ; 66 ; open government ; open government licen[sc]e(?: v3 0| v2 0| v1 0)?
apsl ; 66 ; apple public ; apple public source licen[sc]e
ipl ; 66 ; ibm public ; ibm public licen[sc]e
npl ; 66 ; netscape ; netscape public licen[sc]e
sissl ; 66 ; sun industry ; sun industry standards source licen[sc]e
zpl ; 66 ; zope ; zope public licen[sc]e
hpnd ; 66 ; historical permission ; historical permission notice and disclaimer
busl ; 66 ; busl ; busl(?: 1 1)?
sspl ; 66 ; sspl ; sspl(?: v?1(?: 0)?)?
polyform ; 66 ; polyform ; polyform (?:noncommercial|strict|shield|small business|perimeter|free trial|internal use) licen[sc]e
openrail ; 66 ; rail ; (?:creativeml )?open ?rail(?: ?\+\+)?(?: m| s)?(?: licen[sc]e)?
llama ; 60 ; llama ; llama (?:[0-9 ]+)?community license
# creative commons short forms, most specific first
cc-by-nc-nd ; 66 ; nc nd ; cc by nc nd
cc-by-nc-sa ; 66 ; nc sa ; cc by nc sa
cc-by-nc ; 60 ; cc by nc ; cc by nc
cc-by-nd ; 60 ; cc by nd ; cc by nd
cc-by-sa ; 60 ; cc by sa ; cc by sa
cc-by-nc-nd-4.0 ; 70 ; nc nd ; cc by nc nd 4 0
cc-by-nc-nd-3.0 ; 70 ; nc nd ; cc by nc nd 3 0
cc-by-nc-sa-4.0 ; 70 ; nc sa ; cc by nc sa 4 0
cc-by-nc-sa-3.0 ; 70 ; nc sa ; cc by nc sa 3 0
cc-by-nc-4.0 ; 70 ; cc by nc ; cc by nc 4 0
cc-by-nc-3.0 ; 70 ; cc by nc ; cc by nc 3 0
cc-by-nd-4.0 ; 70 ; cc by nd ; cc by nd 4 0
cc-by-nd-3.0 ; 70 ; cc by nd ; cc by nd 3 0
cc-by-sa-4.0 ; 70 ; cc by sa ; cc by sa 4 0
cc-by-sa-3.0 ; 70 ; cc by sa ; cc by sa 3 0
cc-by-sa-2.5 ; 70 ; cc by sa ; cc by sa 2 5
cc-by-sa-2.0 ; 70 ; cc by sa ; cc by sa 2 0
cc-by-4.0 ; 70 ; cc by 4 ; cc by 4 0
cc-by-3.0 ; 70 ; cc by 3 ; cc by 3 0
cc-by-2.5 ; 70 ; cc by 2 ; cc by 2 5
cc-by-2.0 ; 70 ; cc by 2 ; cc by 2 0
cc-by ; 50 ; cc by ; cc by
cc-by-nc-nd ; 62 ; creative commons ; creative commons attribution non ?commercial no ?deriv(?:ative)?s
cc-by-nc-sa ; 62 ; creative commons ; creative commons attribution non ?commercial share ?alike
cc-by-nc ; 58 ; creative commons ; creative commons attribution non ?commercial
cc-by-nd ; 58 ; creative commons ; creative commons attribution no ?deriv(?:ative)?s
cc-by-sa ; 58 ; creative commons ; creative commons attribution share ?alike
cc-by ; 54 ; creative commons ; creative commons attribution(?: licen[sc]e)?
cc-by-4.0 ; 76 ; creativecommons org ; creativecommons org licenses by 4 0
cc-by-sa-4.0 ; 76 ; creativecommons org ; creativecommons org licenses by sa 4 0
cc-by-nc-4.0 ; 76 ; creativecommons org ; creativecommons org licenses by nc 4 0
cc-by-nd-4.0 ; 76 ; creativecommons org ; creativecommons org licenses by nd 4 0
cc-by-nc-sa-4.0 ; 76 ; creativecommons org ; creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0 ; 76 ; creativecommons org ; creativecommons org licenses by nc nd 4 0
cc-by-3.0 ; 76 ; creativecommons org ; creativecommons org licenses by 3 0
cc-by-sa-3.0 ; 76 ; creativecommons org ; creativecommons org licenses by sa 3 0
cc0-1.0 ; 76 ; creativecommons org ; creativecommons org publicdomain zero 1 0
creative-commons ; 40 ; creative commons ; creative commons(?: licen[sc]e)?
# notices
reserved ; 40 ; all rights reserved ; all rights reserved
reserved ; 52 ; all rights reserved ; copyright ~ all rights reserved
reserved ; 46 ; rights reserved ; (?:some|no) rights reserved
proprietary ; 60 ; proprietary ; proprietary and confidential
proprietary ; 60 ; written permission ; may not be (?:reproduced|copied|distributed|used) ~ without (?:the )?(?:prior |express )?written permission
proprietary ; 56 ; unauthorized ; unauthorized (?:copying|use|reproduction|distribution) ~ is (?:strictly )?prohibited
noncommercial ; 50 ; non ; for non ?commercial (?:use|purposes) only
gpl ; 44 ; general public license ; general public license
public-domain ; 40 ; public domain ; public domain
# licences named in other languages
gpl ; 60 ; licence publique ; licence publique g[ée]n[ée]rale gnu
cc-by ; 54 ; creative commons ; creative commons (?:paternit[ée]|attribution)
cc-by ; 54 ; namensnennung ; creative commons namensnennung
cc-by ; 54 ; creative commons ; creative commons (?:reconocimiento|atribuci[óo]n)
reserved ; 46 ; droits ; tous droits r[ée]serv[ée]s
reserved ; 46 ; alle rechte ; alle rechte vorbehalten
reserved ; 46 ; todos los derechos ; todos los derechos reservados
public-domain ; 40 ; domaine public ; domaine public
public-domain ; 40 ; gemeinfrei ; gemeinfrei
public-domain ; 40 ; dominio ; dominio p[úu]blico
"""


class Signature(NamedTuple):
    label: str
    priority: int
    keyword: bytes
    pattern: re.Pattern
    order: int


def _compiled(text: str) -> re.Pattern:
    grown = text.replace(" ~ ", r" (?:[^ ]+ ){1,3}?")
    grown = re.sub(r"\[([^\]]*[^\x00-\x7f][^\]]*)\]", lambda m: "(?:" + "|".join(m[1]) + ")", grown)  # bytes have no classes of longer characters
    return re.compile(f"(?<= )(?:{grown})(?= )".encode())


def signatures() -> list[Signature]:
    """All rules in order: identifiers, then the table from top to bottom."""
    out = []
    for name in IDENTIFIERS.split():
        words = " ".join(re.findall("[0-9a-z]+", name.lower()))
        out.append((name.lower(), 98, "spdx", f"spdx license identifier {words}"))
    for line in SIGNATURES.strip().splitlines():
        if not line.startswith("#"):
            label, priority, keyword, pattern = (x.strip() for x in line.split(" ; "))
            out.append((label, int(priority), keyword, pattern))
    return [Signature(label, priority, keyword.encode(), _compiled(pattern), i) for i, (label, priority, keyword, pattern) in enumerate(out)]
