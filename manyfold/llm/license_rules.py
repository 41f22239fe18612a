"""Hand-written license signatures over normalised words.

Each line: label | priority (1 wins over 2 wins over 3) | keyword that a text must hold | regular expression over lower-case
words with single blanks.  Priority 1: a titled licence with its version or a sentence of its text; 2: a name; 3: an
identifier or a reference that says less.  A gap's bound, as in ``.{0,60}``, is part of the rule's text: phrases further apart are
no such signature.
"""

from __future__ import annotations

_TABLE = """
mit | 1 | mit | under the (?:terms of the )?mit (?:expat )?license
mit | 1 | permission | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | 2 | permission | the above copyright notice and this permission notice shall be included in all copies
mit | 2 | mit | (?:the )?mit license(?: mit)?
mit | 2 | expat | expat license
mit | 3 | identifier | spdx license identifier mit
mit | 3 | mit | mit licen[cs]ed
mit-0 | 1 | mit | mit no attribution(?: license)?
mit-0 | 3 | identifier | spdx license identifier mit 0
x11 | 2 | x11 | x11 license
x11 | 3 | identifier | spdx license identifier x11
apache-2 | 1 | apache | (?:under the )?apache license version 2(?: 0)?
apache-2 | 1 | apache | apache software license version 2(?: 0)?
apache-2 | 2 | apache | apache (?:license )?v?2(?: 0)?(?: license)?
apache-2 | 2 | apache | apache org licenses license 2 0
apache-2 | 3 | identifier | spdx license identifier apache 2 0
apache-1.1 | 1 | apache | apache (?:software )?license version 1 1
apache-1.1 | 3 | identifier | spdx license identifier apache 1 1
apache-1 | 1 | apache | apache (?:software )?license version 1 0
apache-1 | 3 | identifier | spdx license identifier apache 1 0
apache | 3 | apache | (?:the )?apache (?:software )?license
bsd-3-clause | 1 | bsd | bsd 3 clause(?: (?:new|revised|modified))?(?: license)?
bsd-3-clause | 1 | bsd | (?:3|three) clause bsd(?: license)?
bsd-3-clause | 1 | endorse | neither the name of .{1,80} nor the names of its contributors may be used to endorse or promote products
bsd-3-clause | 2 | bsd | (?:new|revised|modified) bsd license
bsd-3-clause | 3 | identifier | spdx license identifier bsd 3 clause
bsd-2-clause | 1 | bsd | bsd 2 clause(?: simplified)?(?: license)?
bsd-2-clause | 1 | bsd | (?:2|two) clause bsd(?: license)?
bsd-2-clause | 2 | bsd | simplified bsd license
bsd-2-clause | 2 | freebsd | freebsd license
bsd-2-clause | 3 | identifier | spdx license identifier bsd 2 clause
bsd-4-clause | 1 | bsd | bsd 4 clause(?: original)?(?: license)?
bsd-4-clause | 1 | bsd | (?:4|four) clause bsd(?: license)?
bsd-4-clause | 1 | advertising | all advertising materials mentioning features or use of this software must display
bsd-4-clause | 3 | identifier | spdx license identifier bsd 4 clause
bsd-zero | 1 | bsd | (?:bsd zero clause|zero clause bsd)(?: license)?
bsd-zero | 2 | 0bsd | 0bsd(?: license)?
bsd | 2 | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd | 3 | bsd | (?:the )?bsd (?:style )?license
bsd | 3 | bsd | bsd licensed
isc | 1 | permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | 2 | isc | isc license
isc | 3 | identifier | spdx license identifier isc
gpl-3 | 1 | gnu | gnu general public license (?:version|v) ?3(?: 0)?(?: only| or (?:any )?later)?
gpl-3 | 1 | gnu | gnu general public license as published by the free software foundation either version 3
gpl-3 | 2 | gplv3 | gplv3(?: license)?
gpl-3 | 2 | gpl | gpl (?:version |v)?3(?: 0)?(?: only| or later)?
gpl-3 | 3 | identifier | spdx license identifier gpl 3 0(?: only| or later)?
gpl-2 | 1 | gnu | gnu general public license (?:version|v) ?2(?: 0)?(?: only| or (?:any )?later)?
gpl-2 | 1 | gnu | gnu general public license as published by the free software foundation either version 2
gpl-2 | 2 | gplv2 | gplv2(?: license)?
gpl-2 | 2 | gpl | gpl (?:version |v)?2(?: 0)?(?: only| or later)?
gpl-2 | 3 | identifier | spdx license identifier gpl 2 0(?: only| or later)?
gpl-1 | 1 | gnu | gnu general public license (?:version|v) ?1(?: 0)?
gpl-1 | 3 | identifier | spdx license identifier gpl 1 0(?: only| or later)?
gpl | 3 | gnu | gnu general public license
gpl | 3 | gnu | gnu gpl
gpl | 3 | gpl | (?:under the )?gpl license
lgpl-3 | 1 | gnu | gnu lesser general public license (?:version|v) ?3(?: 0)?(?: or (?:any )?later)?
lgpl-3 | 2 | lgplv3 | lgplv3
lgpl-3 | 2 | lgpl | lgpl (?:version |v)?3(?: 0)?(?: only| or later)?
lgpl-3 | 3 | identifier | spdx license identifier lgpl 3 0(?: only| or later)?
lgpl-2.1 | 1 | gnu | gnu lesser general public license (?:version|v) ?2 1(?: or (?:any )?later)?
lgpl-2.1 | 2 | lgpl | lgpl (?:version |v)?2 1(?: only| or later)?
lgpl-2.1 | 3 | identifier | spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-2 | 1 | gnu | gnu library general public license (?:version|v) ?2(?: 0)?
lgpl-2 | 3 | identifier | spdx license identifier lgpl 2 0(?: only| or later)?
lgpl | 3 | gnu | gnu (?:lesser|library) general public license
lgpl | 3 | lgpl | (?:gnu )?lgpl(?: license)?
agpl-3 | 1 | gnu | gnu affero general public license (?:version|v) ?3(?: 0)?(?: or (?:any )?later)?
agpl-3 | 2 | agplv3 | agplv3
agpl-3 | 2 | agpl | agpl (?:version |v)?3(?: 0)?(?: only| or later)?
agpl-3 | 3 | identifier | spdx license identifier agpl 3 0(?: only| or later)?
agpl | 3 | affero | (?:gnu )?affero general public license
fdl-1.3 | 1 | gnu | gnu free documentation license version 1 3(?: or any later version)?
fdl-1.2 | 1 | gnu | gnu free documentation license version 1 2(?: or any later version)?
fdl-1.1 | 1 | gnu | gnu free documentation license version 1 1
fdl | 3 | gnu | gnu free documentation license
fdl | 3 | gfdl | gfdl
mpl-2 | 1 | mozilla | mozilla public license (?:version|v) ?2(?: 0)?
mpl-2 | 1 | mozilla | source code form is subject to the terms of the mozilla public license v 2 0
mpl-2 | 2 | mpl | mpl (?:version |v)?2(?: 0)?
mpl-2 | 3 | identifier | spdx license identifier mpl 2 0
mpl-1.1 | 1 | mozilla | mozilla public license (?:version|v) ?1 1
mpl-1.1 | 2 | mpl | mpl (?:version |v)?1 1
mpl-1.1 | 3 | identifier | spdx license identifier mpl 1 1
mpl-1 | 1 | mozilla | mozilla public license (?:version|v) ?1 0
mpl | 3 | mozilla | mozilla public license
epl-2 | 1 | eclipse | eclipse public license (?:version |v )?2 0
epl-2 | 3 | identifier | spdx license identifier epl 2 0
epl-1 | 1 | eclipse | eclipse public license (?:version |v )?1 0
epl-1 | 3 | identifier | spdx license identifier epl 1 0
epl | 3 | eclipse | eclipse public license
edl-1 | 1 | eclipse | eclipse distribution license (?:version |v )?1 0
cddl-1.1 | 1 | cddl | cddl (?:version )?1 1
cddl-1 | 1 | cddl | cddl (?:version )?1 0
cddl | 2 | distribution | common development and distribution license
cpl-1 | 2 | common | common public license(?: version)?(?: 1 0)?
cpal-1 | 2 | attribution | common public attribution license(?: version)?(?: 1 0)?
eupl-1.2 | 1 | eupl | eupl (?:version |v )?1 2
eupl-1.1 | 1 | eupl | eupl (?:version |v )?1 1
eupl | 2 | european | european union public licen[cs]e
artistic-2 | 1 | artistic | artistic license (?:version )?2 0
artistic-1 | 1 | artistic | artistic license (?:version )?1 0
artistic | 3 | artistic | artistic license
zlib | 1 | misrepresented | the origin of this software must not be misrepresented
zlib | 2 | zlib | zlib (?:libpng )?license
zlib | 3 | identifier | spdx license identifier zlib
libpng | 2 | libpng | libpng license
boost-1 | 1 | boost | boost software license(?: version)? 1 0
boost-1 | 3 | identifier | spdx license identifier bsl 1 0
boost | 3 | boost | boost software license
unlicense | 1 | unencumbered | this is free and unencumbered software released into the public domain
unlicense | 2 | unlicense | (?:the )?unlicense
wtfpl | 1 | want | do what the [^ ]+ you want to public license(?: version 2)?
wtfpl | 3 | wtfpl | wtfpl
cc0 | 1 | cc0 | cc0 1 0 universal(?: public domain dedication)?
cc0 | 2 | cc0 | (?:creative commons )?cc0(?: 1 0)?
cc0 | 2 | creative | creative commons zero
cc0 | 3 | publicdomain | creativecommons org publicdomain zero 1 0
public-domain-mark | 3 | publicdomain | creativecommons org publicdomain mark 1 0
public-domain | 2 | domain | (?:released|dedicated|placed) (?:in|to|into) the public domain
public-domain | 3 | domain | (?:is|are) in the public domain
public-domain | 2 | domain | public domain dedication
cc-by-nc-nd | 1 | creative | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?(?: international| unported| license)*
cc-by-nc-nd | 1 | cc | cc by nc nd(?: [1-4] [05])?(?: international| unported| license)*
cc-by-nc-nd | 3 | creativecommons | creativecommons org licenses by nc nd
cc-by-nc-sa | 1 | creative | creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported| license)*
cc-by-nc-sa | 1 | cc | cc by nc sa(?: [1-4] [05])?(?: international| unported| license)*
cc-by-nc-sa | 3 | creativecommons | creativecommons org licenses by nc sa
cc-by-nc | 1 | creative | creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported| license)*
cc-by-nc | 1 | cc | cc by nc [1-4] [05](?: international| unported| license)*
cc-by-nc | 2 | cc | cc by nc
cc-by-nc | 3 | creativecommons | creativecommons org licenses by nc
cc-by-nd | 1 | creative | creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?(?: international| unported| license)*
cc-by-nd | 1 | cc | cc by nd(?: [1-4] [05])?(?: international| unported| license)*
cc-by-nd | 3 | creativecommons | creativecommons org licenses by nd
cc-by-sa | 1 | creative | creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported| license)*
cc-by-sa | 1 | cc | cc by sa(?: [1-4] [05])?(?: international| unported| license)*
cc-by-sa | 3 | creativecommons | creativecommons org licenses by sa
cc-by | 1 | creative | creative commons attribution(?: [1-4] [05])?(?: international| unported| license)+
cc-by | 1 | cc | cc by [1-4] [05](?: international| unported| license)*
cc-by | 3 | creativecommons | creativecommons org licenses by
creative-commons | 3 | creative | creative commons license
odbl | 1 | database | open database license(?: version)?(?: v?1 0)?
odbl | 3 | odbl | odbl(?: 1 0)?
odc-by | 1 | commons | open data commons attribution license(?: v?1 0)?
pddl | 1 | dedication | (?:open data commons )?public domain dedication and licen[cs]e
ogl-3 | 1 | government | open government licen[cs]e v?3 0
ogl | 2 | government | open government licen[cs]e
cdla-permissive | 1 | community | community data license agreement permissive(?: version)?(?: [12] 0)?
cdla-sharing | 1 | community | community data license agreement sharing(?: version)?(?: 1 0)?
ofl-1.1 | 1 | sil | sil open font license(?: version)? 1 1
ofl | 2 | sil | sil open font license
ofl | 3 | ofl | ofl 1 [01]
ms-pl | 2 | microsoft | microsoft public license(?: ms pl)?
ms-rl | 2 | microsoft | microsoft reciprocal license(?: ms rl)?
psf-2 | 1 | python | python software foundation license(?: version)?(?: 2)?
python-2 | 1 | python | python license(?: version)? 2(?: 0)?
php-3 | 1 | php | php license(?: version)? 3 01?
ruby | 2 | ruby | ruby license
perl | 2 | perl | same terms as perl(?: itself)?
openssl | 1 | openssl | openssl license
openssl | 2 | openssl | this product includes software developed by the openssl project
ssleay | 2 | ssleay | ssleay license
w3c | 2 | w3c | w3c software (?:notice and )?license
w3c | 3 | identifier | spdx license identifier w3c
nasa-1.3 | 2 | nasa | nasa open source agreement(?: version)?(?: 1 3)?
ncsa | 1 | ncsa | university of illinois ncsa open source license
ncsa | 3 | identifier | spdx license identifier ncsa
postgresql | 2 | postgresql | postgresql licen[cs]e
intel | 2 | intel | intel open source license
ibm-public | 2 | ibm | ibm public license(?: version)?(?: 1 0)?
apple-2 | 2 | apple | apple public source license(?: version)?(?: 2 0)?
sun-public | 2 | sun | sun public license
sissl | 2 | sun | sun industry standards source license
qpl | 1 | public | q public license(?: version)?(?: 1 0)?
lppl-1.3 | 1 | latex | latex project public license(?: version)?(?: 1 3[ac]?)?
vim | 2 | vim | vim license
afl-3 | 1 | academic | academic free license(?: version)?(?: 3 0)?
osl-3 | 1 | open | open software license(?: version)? 3 0
ecl-2 | 1 | educational | educational community license(?: version)?(?: 2 0)?
upl-1 | 1 | universal | universal permissive license(?: version)?(?: 1 0)?
cecill-2.1 | 1 | cecill | cecill (?:free software license agreement )?(?:version )?2 1
cecill-b | 1 | cecill | cecill b(?: license)?
cecill-c | 1 | cecill | cecill c(?: license)?
cecill | 3 | cecill | cecill
mulan-2 | 1 | mulan | mulan (?:psl|permissive software license) (?:version |v)?2
mulan | 3 | mulan | mulan (?:psl|permissive software license)
sspl-1 | 1 | server | server side public license(?: version)?(?: 1)?
sspl-1 | 3 | sspl | sspl(?: 1 0)?
bsl-1.1 | 1 | business | business source license(?: version)?(?: 1 1)?
elastic-2 | 1 | elastic | elastic license(?: version)?(?: 2 0)?
commons-clause | 1 | clause | commons clause(?: license condition)?
polyform-nc | 1 | polyform | polyform noncommercial license(?: 1 0 0)?
polyform-sb | 1 | polyform | polyform small business license(?: 1 0 0)?
polyform | 3 | polyform | polyform
rail | 1 | rail | (?:creativeml )?open rail [ms] license
rail | 2 | responsible | responsible ai license
openrail | 2 | openrail | (?:bigscience |creativeml )?openrail(?: m)?
hippocratic | 1 | hippocratic | hippocratic license(?: version)?(?: [123] [01])?
json | 1 | evil | the software shall be used for good not evil
json | 2 | json | json license
beerware | 1 | beer | you can buy me a beer in return
beerware | 2 | beerware | beerware license
tidy | 2 | tidy | html tidy license
curl | 2 | curl | curl license
blueoak-1 | 1 | blue | blue oak model license(?: 1 0 0)?
osgi | 2 | osgi | osgi specification license
proprietary | 1 | rights | all rights reserved
proprietary | 1 | confidential | (?:proprietary and confidential|confidential and proprietary)
proprietary | 2 | unauthorized | unauthorized (?:copying|use|distribution|reproduction) .{0,60}(?:is )?(?:strictly )?prohibited
proprietary | 2 | permission | (?:no part of this|may not be reproduced) .{0,80}without (?:the )?(?:prior )?written permission
non-commercial | 2 | commercial | for non commercial (?:use|purposes)(?: only)?
non-commercial | 2 | noncommercial | for noncommercial (?:use|purposes)(?: only)?
personal-use | 2 | personal | for personal use only
academic-use | 2 | academic | for academic (?:use|purposes) only
academic-use | 2 | research | for research (?:use|purposes) only
academic-use | 2 | educational | for educational (?:use|purposes) only
no-derivatives | 3 | derivative | no derivative works
share-alike | 3 | alike | share alike license
terms-of-use | 3 | terms | subject to (?:the|these|our) terms (?:of use|of service|and conditions)
copyright | 3 | copyright | copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)?[0-9]{2,4})?(?: by)?
free-software | 3 | redistribute | this program is free software you can redistribute it and or modify it
as-is | 3 | warranty | (?:is )?provided as is without warranty of any kind
as-is | 3 | warranties | distributed on an as is basis without warranties or conditions of any kind
licence-notice | 3 | licensed | licensed under the terms (?:of|in|found)
licence-notice | 3 | license | (?:see|read) the license (?:file|for)
licence-notice | 3 | licence | (?:see|read) the licence (?:file|for)
"""


#: (label, priority, keyword, expression), in the order written.
RULES = [(label, int(priority), keyword, expression) for label, priority, keyword, expression in (map(str.strip, line.split(" | ")) for line in _TABLE.strip().splitlines())]
#: Contract phrases: label by phrase; their places always count.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
