"""Signature rules of licences over normal text: lower-case words joined by one blank.

``WRITTEN`` holds the rules written by hand, from the notices, headers, titles and addresses of each licence: label,
priority (lower wins), keyword, pattern; every match of a pattern has its keyword, from a word's beginning on. :func:`templates` adds the plain forms that names and identifiers of families have in
common ("licensed under the X license version n", SPDX tags). A rule is tried only where its keyword stands in the text.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    keyword: str  # a rule is tried only where a word of the text begins so
    pattern: str
    label: str
    priority: int  # lower wins
    weight: float


# Every keyword, with a blank before it, holds one of these; texts without any are done at once.
GATES = [
    " licen", " copyright", " copyleft", " spdx", " rights reserved", " public domain", " creative", " cc", " gpl", " lgpl", " agpl", " permission", " warrant",
    " redistribut", " proprietary", " confidential", " strictly prohibited", " noncommercial", " non commercial", " apache", " gnu ", " bsd", " mozilla",
    " mpl", " asl", " expat", " x11", " x consortium", " mit no", " mit x11", " runtime library", " eclipse org", " terms as perl", " openssl", " cryptographic software",
    " w3c", " cecill", " watcom", " mulan", " polyform", " openrail", " open rail", " for good not evil", " datenlizenz", " copy of the", " opensource org",
    " 0bsd", " unlicense", " freebsd", " may be used to endorse", " advertising materials", " as a special exception", " work of the united",
]

WRITTEN = r"""
apache-2.0 | 10 | apache license | licensed under the apache license version 2 0(?: the license)?
apache-2.0 | 10 | apache license | apache license version 2 0 january 2004
apache-2.0 | 10 | apache org licenses | (?:http |https )?www apache org licenses license 2 0(?: txt| html)?
apache-2.0 | 11 | compliance with the license | you may not use this file except in compliance with the license
apache-2.0 | 11 | distributed under the license | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2.0 | 15 | apache | (?:the )?apache(?: software)? license(?: version| v)? ?2(?: 0)?
apache-2.0 | 25 | apache | apache (?:v |version )?2 0
apache-2.0 | 25 | apache2 | apache2(?: 0)?(?: license)?
apache-2.0 | 15 | apachev2 | apachev2(?: license)?
apache-2.0 | 20 | asl | asl 2 0|aslv2|asl license 2 0
apache-1.1 | 10 | apache software license | apache software license version 1 1
apache-1.1 | 11 | redistribut | the end user documentation included with the redistribution if any must include the following acknowledgment
apache-1.0 | 10 | apache | apache(?: software)? license version 1 0
apache-1.0 | 12 | apache group | this product includes software developed by the apache group
apache | 30 | apache | (?:the )?apache(?: software)? license
apache | 40 | licensed to the apache | licensed to the apache software foundation(?: asf)? under one or more contributor license agreements
mit | 10 | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | 12 | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy
mit | 12 | permission notice | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | 12 | warranty of any kind | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
mit | 15 | mit license | (?:the )?mit license(?: mit)?
mit | 15 | license mit | (?:under (?:the )?)?license mit
mit | 16 | licensed under the mit | (?:is )?licensed under the mit
mit | 20 | mit licensed | (?:is )?mit licensed
mit | 15 | opensource org licenses mit | opensource org licenses mit(?: license)?(?: php| html)?
mit | 16 | expat | expat license|license expat|expat style license
mit | 30 | mit x11 | mit x11(?: license)?
mit | 30 | style license | mit style license
mit-0 | 11 | mit no attribution | mit no attribution(?: license)?
mit-0 | 12 | mit 0 license | mit 0 license
x11 | 12 | x consortium | except as contained in this notice the name of the x consortium shall not be used in advertising
x11 | 20 | x11 license | x11 license
isc | 10 | permission to use copy | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | 11 | permission to use copy | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted
isc | 15 | isc license | (?:the )?isc license
isc | 16 | isc licen | isc licensed|isc licence
0bsd | 9 | zero clause bsd | (?:bsd )?zero clause bsd(?: license)?
0bsd | 10 | 0bsd | 0bsd(?: license)?
0bsd | 10 | bsd 0 clause | bsd 0 clause(?: license)?
bsd | 25 | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted
bsd | 30 | redistribution and use | redistribution and use in source and binary forms
bsd-2-clause | 10 | bsd 2 clause | bsd 2 clause(?: simplified)?(?: license)?
bsd-2-clause | 10 | bsd | (?:the )?(?:2|two) clause bsd(?: license)?|simplified bsd license
bsd-2-clause | 12 | freebsd license | freebsd license
bsd-3-clause | 10 | bsd 3 clause | bsd 3 clause(?: new| revised)?(?: license)?
bsd-3-clause | 10 | bsd | (?:the )?(?:3|three) clause bsd(?: license)?|(?:new|modified|revised) bsd license
bsd-3-clause | 11 | may be used to endorse | neither the names? of (?:the )?(?:[^ ]+ ){1,12}nor the names of (?:its|their|any) contributors may be used to endorse or promote products derived from this software
bsd-4-clause | 10 | bsd | (?:the )?(?:4|four) clause bsd(?: license)?|(?:original|old) bsd license
bsd-4-clause | 10 | bsd 4 clause | bsd 4 clause(?: license)?
bsd-4-clause | 12 | advertising materials mentioning | all advertising materials mentioning features or use of this software must display the following acknowledg?ement
bsd | 30 | bsd | (?:the )?bsd(?: style)? licen[sc]e
bsd | 40 | bsd style | bsd style(?: open source)?(?: licen[sc]e)?
bsd | 30 | bsd | (?:licensed|released|distributed) under the (?:terms of the )?bsd
gpl-1 | 9 | gnu general public license | gnu general public license(?: as published by the free software foundation)? either version 1(?: of the license)?(?: or at your option any later version)?
gpl-2 | 9 | gnu general public license | gnu general public license(?: as published by the free software foundation)? (?:either )?version 2(?: of the license)?(?: or at your option any later version)?
gpl-3 | 9 | gnu general public license | gnu general public license(?: as published by the free software foundation)? (?:either )?version 3(?: of the license)?(?: or at your option any later version)?
gpl-2 | 9 | general public license | general public license version 2 june 1991
gpl-3 | 9 | general public license | general public license version 3 29 june 2007
gpl-2 | 14 | gplv2 | gplv2(?: or later| only)?(?: license)?
gpl-3 | 14 | gplv3 | gplv3(?: or later| only)?(?: license)?
gpl-2 | 15 | gpl | (?:gnu )?gpl (?:version |v )?2(?: 0)?(?: or later| only)?
gpl-3 | 15 | gpl | (?:gnu )?gpl (?:version |v )?3(?: 0)?(?: or later| only)?
gpl-2 | 14 | gpl v2 | (?:gnu )?gpl v2(?: 0)?(?: or later)?
gpl-3 | 14 | gpl v3 | (?:gnu )?gpl v3(?: 0)?(?: or later)?
gpl | 30 | gnu general public license | (?:the )?gnu general public license
gpl | 40 | gnu gpl | (?:the )?gnu gpl
gpl | 45 | gpl licen | gpl licen[sc]e|gpl licensed
gpl | 45 | gpl | (?:licensed|released|distributed) under the (?:terms of the )?gpl
gpl | 50 | gnu org licenses gpl | www gnu org licenses gpl(?: html| txt)?
gpl-2 | 12 | gnu org licenses | gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt)?
gpl-3 | 12 | gnu org licenses | gnu org licenses gpl 3 0(?: html| txt)?
lgpl-2 | 8 | general public license | gnu library general public license(?: as published by the free software foundation)? (?:either )?version 2(?: of the license)?
lgpl-2.1 | 8 | general public license | gnu lesser general public license(?: as published by the free software foundation)? (?:either )?version 2 1(?: of the license)?(?: or at your option any later version)?
lgpl-3 | 8 | general public license | gnu lesser general public license(?: as published by the free software foundation)? (?:either )?version 3(?: of the license)?(?: or at your option any later version)?
lgpl-2.1 | 8 | lesser general public license | lesser general public license version 2 1 february 1999
lgpl-3 | 8 | lesser general public license | lesser general public license version 3 29 june 2007
lgpl-2.1 | 13 | lgpl | (?:gnu )?lgpl (?:version |v )?2 1(?: or later| only)?|lgpl v2 1|lgplv2 1
lgpl-3 | 13 | lgpl | (?:gnu )?lgpl (?:version |v )?3(?: 0)?(?: or later| only)?|lgpl v3|lgplv3
lgpl-2 | 14 | lgpl | lgpl v2 0|lgplv2|lgpl 2 0
lgpl | 28 | general public license | (?:the )?gnu (?:lesser|library) general public license
lgpl | 40 | lgpl | lgpl licen[sc]e|under the (?:terms of the )?(?:gnu )?lgpl
agpl-3 | 8 | affero general public license | (?:gnu )?affero general public license(?: as published by the free software foundation)? (?:either )?version 3(?: of the license)?(?: or at your option any later version)?
agpl-3 | 8 | affero general public license | affero general public license version 3 19 november 2007
agpl-3 | 13 | agpl | (?:gnu )?agpl (?:version |v )?3(?: 0)?|agplv3|agpl v3
agpl-1 | 10 | affero general public license | affero general public license version 1
agpl | 28 | affero general public license | (?:the )?(?:gnu )?affero general public license
agpl | 40 | agpl | agpl licen[sc]e|under the (?:terms of the )?(?:gnu )?agpl
gfdl-1.1 | 9 | free documentation license | gnu free documentation license version 1 1
gfdl-1.2 | 9 | free documentation license | gnu free documentation license version 1 2
gfdl-1.3 | 9 | free documentation license | gnu free documentation license version 1 3
gfdl | 28 | free documentation license | (?:the )?gnu free documentation license
gpl-exception-classpath | 7 | permission to link | as a special exception the copyright holders of this library give you permission to link this library with independent modules
gpl-exception-font | 7 | as a special exception | as a special exception if you create a document which uses this font
gpl-exception-font | 8 | gpl font exception | gpl font exception
gcc-exception | 7 | gcc runtime library exception | gcc runtime library exception(?: version 3 1)?
mpl-1.0 | 9 | mozilla public license | mozilla public license (?:version |v )?1 0
mpl-1.1 | 9 | mozilla public license | mozilla public license (?:version |v )?1 1
mpl-2.0 | 9 | mozilla public license | mozilla public license (?:version |v )?2 0
mpl-2.0 | 9 | mozilla public license | this source code form is subject to the terms of the mozilla public license(?: (?:version |v )?2 0)?
mpl-2.0 | 12 | mozilla org mpl | mozilla org mpl 2 0
mpl-1.1 | 12 | mozilla org mpl | mozilla org mpl mpl 1 1(?: html)?
mpl-2.0 | 14 | mpl | mpl (?:version |v )?2 0(?: licen[sc]e)?|mplv2(?: licen[sc]e)?
mpl | 30 | mozilla public license | (?:the )?mozilla public license
npl | 12 | netscape public license | netscape public license(?: version 1 [01])?
epl-1.0 | 9 | eclipse public license | eclipse public license (?:version |v )?1 0
epl-2.0 | 9 | eclipse public license | eclipse public license (?:version |v )?2 0
epl-1.0 | 12 | eclipse org legal | (?:www )?eclipse org legal epl v10(?: html)?
epl | 30 | eclipse public license | (?:the )?eclipse public license
edl-1.0 | 10 | eclipse distribution license | eclipse distribution license (?:version |v )?1 0
cpl-1.0 | 10 | common public license | common public license (?:version |v )?1 0
cpl | 30 | common public license | (?:the )?common public license
ipl-1.0 | 10 | ibm public license | ibm public license (?:version |v )?1 0
cddl-1.0 | 10 | distribution license | common development and distribution license(?: cddl)? (?:version |v )?1 0
cddl-1.1 | 10 | distribution license | common development and distribution license(?: cddl)? (?:version |v )?1 1
cddl | 30 | distribution license | (?:the )?common development and distribution license
eupl-1.1 | 10 | european union public licen | european union public licen[sc]e(?: eupl)? (?:version |v )?1 1
eupl-1.2 | 10 | european union public licen | european union public licen[sc]e(?: eupl)? (?:version |v )?1 2
eupl | 30 | european union public licen | (?:the )?european union public licen[sc]e
artistic-1.0 | 10 | artistic license | (?:the )?artistic license 1 0
artistic-2.0 | 10 | artistic license | (?:the )?artistic license (?:version |v )?2 0
artistic | 30 | artistic license | (?:the )?artistic license
perl | 20 | terms as perl | (?:under )?the same terms as perl(?: 5)?(?: itself)?
zlib | 11 | warranty in no event | this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib | 12 | permission is granted to anyone | permission is granted to anyone to use this software for any purpose including commercial applications
zlib | 20 | zlib licen | zlib licen[sc]e|zlib licensed
libpng | 15 | libpng license | (?:zlib )?libpng license
boost-1.0 | 9 | boost software license | (?:distributed under the )?boost software license version 1 0
boost-1.0 | 12 | boost org license | boost org license 1 0(?: txt)?
boost | 30 | boost software license | (?:the )?boost software license
unlicense | 11 | public domain | this is free and unencumbered software released into the public domain
unlicense | 15 | unlicense | (?:the )?unlicense(?: license)?
wtfpl | 11 | public license | do what the fuck you want to public license(?: version 2)?
wtfpl | 20 | wtfpl licen | wtfpl licen[sc]e|wtfpl licensed
beerware | 11 | beer ware license | beer ware license(?: revision 42)?
beerware | 20 | beerware licen | beerware licen[sc]e
python-2.0 | 11 | python software foundation license | python software foundation license version 2
python | 25 | python software foundation license | (?:the )?python software foundation license
python | 26 | python license | python license
python | 25 | psf license | psf license(?: agreement)?
postgresql | 12 | postgresql licen | (?:the )?postgresql licen[sc]e
postgresql | 12 | permission to use copy | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
ofl-1.1 | 10 | open font license | sil open font license (?:version |v )?1 1
ofl | 28 | open font license | (?:the )?sil open font license
openssl | 11 | openssl | openssl licen[sc]e|(?:the )?openssl license
openssl | 13 | openssl project for use | this product includes software developed by the openssl project for use in the openssl toolkit
ssleay | 13 | cryptographic software | this product includes cryptographic software written by eric young
php-3.01 | 11 | php license | php license (?:version |v )?3 01
php-3.0 | 11 | php license | php license (?:version |v )?3 0
php | 30 | php license | (?:the )?php license
ruby | 25 | ruby license | (?:the )?ruby license
ruby | 26 | ruby s license | ruby s license
vim | 25 | vim license | (?:the )?vim license
tcl | 25 | tcl license | (?:the )?tcl license
tcl | 25 | tcl tk license | (?:the )?tcl tk license
curl | 20 | curl license | (?:the )?curl license
ijg | 20 | jpeg group license | independent jpeg group license
icu | 20 | icu license | (?:the )?icu license
unicode | 15 | unicode license | unicode license(?: agreement)?(?: data files and software)?
w3c | 15 | w3c | w3c software(?: and document)?(?: notice and)? license
ncsa | 15 | ncsa open source license | (?:university of illinois )?ncsa open source license
intel | 20 | intel open source license | intel open source license
afl-3.0 | 11 | academic free license | academic free license (?:version |v )?3 0
afl-2.1 | 11 | academic free license | academic free license (?:version |v )?2 1
afl | 30 | academic free license | (?:the )?academic free license
osl-3.0 | 11 | open software license | open software license(?: osl)? (?:version |v )?3 0
osl | 30 | open software license | (?:the )?open software license
ms-pl | 12 | microsoft public license | microsoft public license(?: ms pl)?
ms-rl | 12 | microsoft reciprocal license | microsoft reciprocal license(?: ms rl)?
ecl-2.0 | 11 | educational community license | educational community license (?:version |v )?2 0
qpl | 20 | q public license | (?:the )?q public license(?: version 1 0)?
cecill-2.1 | 11 | cecill | cecill (?:free software )?licen[sc]e(?: agreement)? (?:version |v )?2 1
cecill | 25 | cecill | cecill(?: [bc])?(?: free software)? licen[sc]e
sleepycat | 20 | sleepycat license | (?:the )?sleepycat license
json | 10 | for good not evil | the software shall be used for good not evil
watcom | 20 | watcom | sybase open watcom public license
apsl-2.0 | 11 | apple public source license | apple public source license(?: version)? 2 0
apsl | 30 | apple public source license | apple public source license
nasa | 20 | nasa open source agreement license | nasa open source agreement license
upl-1.0 | 11 | universal permissive license | universal permissive license(?: upl)? (?:version |v )?1 0
mulan-2 | 11 | mulan | mulan psl v2|mulan permissive software license (?:version |v ?)2
blueoak-1.0 | 11 | blue oak model license | blue oak model license(?: version)? 1 0 0
sspl-1 | 11 | server side public license | server side public license (?:version |v )?1
sspl | 30 | server side public license | (?:the )?server side public license
busl-1.1 | 11 | business source license | business source license (?:version |v )?1 1
busl | 30 | business source license | (?:the )?business source license
elastic-2.0 | 11 | elastic license | elastic license (?:version |v )?2 0
elastic | 30 | elastic license | (?:the )?elastic license
commons-clause | 12 | commons clause license | commons clause license condition
polyform | 20 | polyform | polyform (?:noncommercial|small business|shield|strict) license(?: 1 0 0)?
hippocratic | 20 | hippocratic license | hippocratic license(?: version)?(?: 2 1| 3 0)?
openrail | 15 | openrail | (?:creativeml |bigscience )?openrail(?: m)?(?: licen[sc]e)?
openrail | 15 | open rail | (?:creativeml |bigscience )?open rail(?: m)?(?: licen[sc]e)?
llama | 15 | community license | llama(?: 2| 3)? community license(?: agreement)?
cc0 | 8 | creative commons | creative commons (?:cc0|zero)(?: 1 0)?(?: universal)?(?: public domain dedication)?(?: license)?
cc0 | 12 | creativecommons org | creativecommons org publicdomain zero 1 0(?: legalcode)?
cc0 | 20 | cc0 | cc0(?: 1 0)?(?: universal)?(?: license)?
cc-pdm | 12 | creativecommons org | creativecommons org publicdomain mark 1 0
cc-by | 15 | creative commons attribution | creative commons attribution(?: license)?
cc-by-4.0 | 9 | creative commons attribution | creative commons attribution 4 0(?: international)?(?: public)?(?: license)?
cc-by-3.0 | 9 | creative commons attribution | creative commons attribution 3 0(?: unported| united states)?(?: license)?
cc-by-2.0 | 9 | creative commons attribution | creative commons attribution 2 0(?: generic)?(?: license)?
cc-by-sa-4.0 | 8 | creative commons attribution | creative commons attribution share ?alike 4 0(?: international)?(?: public)?(?: license)?
cc-by-sa-3.0 | 8 | creative commons attribution | creative commons attribution share ?alike 3 0(?: unported| united states)?(?: license)?
cc-by-sa | 14 | creative commons attribution | creative commons attribution share ?alike(?: license)?
cc-by-nc-4.0 | 8 | creative commons attribution | creative commons attribution non ?commercial 4 0(?: international)?(?: public)?(?: license)?
cc-by-nc | 14 | creative commons attribution | creative commons attribution non ?commercial(?: license)?
cc-by-nd | 14 | creative commons attribution | creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: license)?
cc-by-nc-sa-4.0 | 7 | creative commons attribution | creative commons attribution non ?commercial share ?alike 4 0(?: international)?(?: public)?(?: license)?
cc-by-nc-sa | 13 | creative commons attribution | creative commons attribution non ?commercial share ?alike(?: license)?
cc-by-nc-nd-4.0 | 7 | creative commons attribution | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)? 4 0(?: international)?(?: public)?(?: license)?
cc-by-nc-nd | 13 | creative commons attribution | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: license)?
cc | 35 | creative commons | (?:a )?creative commons licen[sc]e
cc | 50 | creativecommons org licenses | creativecommons org licenses
odbl-1.0 | 11 | open database license | (?:open data commons )?open database license(?: odbl)?(?: (?:version |v )?1 0)?
odc-by-1.0 | 11 | attribution license | open data commons attribution license(?: odc by)?(?: (?:version |v )?1 0)?
pddl-1.0 | 11 | public domain dedication | (?:open data commons )?public domain dedication and licen[sc]e(?: pddl)?(?: (?:version |v )?1 0)?
cdla-permissive-2.0 | 11 | community data license agreement | community data license agreement permissive (?:version )?2 0
cdla-permissive-1.0 | 11 | community data license agreement | community data license agreement permissive (?:version )?1 0
cdla-sharing-1.0 | 11 | community data license agreement | community data license agreement sharing (?:version )?1 0
ogl-uk-3.0 | 10 | open government licen | open government licen[sc]e (?:version |v )?3(?: 0)?|open government licen[sc]e v3(?: 0)?
ogl-uk | 28 | open government licen | (?:the )?open government licen[sc]e
etalab-2.0 | 15 | licence ouverte | licence ouverte (?:open licence )?(?:version |v )?2 0
dl-de-by-2.0 | 15 | datenlizenz | datenlizenz deutschland namensnennung (?:version )?2 0
public-domain | 25 | public domain | (?:is |are |hereby )?(?:dedicated|placed|released|donated) (?:in|into|to|in to) the public domain
public-domain | 40 | public domain | (?:is |are )in the public domain
public-domain | 45 | public domain work | public domain work
public-domain | 46 | work of the united states | (?:a )?work of the united states government
copyright | 60 | copyright | copyright (?:c |© )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?(?: by)?
copyright | 65 | copyright | copyright (?:c|©) (?:by )?[^ ]+ (?:inc|ltd|llc|corp|gmbh|corporation|limited|company)
copyright | 70 | copyright | copyright (?:holder|owner|notice)s?
copyright | 70 | copyright | (?:protected|covered) by(?: [^ ]+){0,3} copyright(?: law| laws)?
copyleft | 60 | copyleft | copyleft licen[sc]e|strong copyleft|weak copyleft
reserved | 50 | rights reserved | all rights reserved
some-rights | 50 | rights reserved | some rights reserved
cc0 | 30 | rights reserved | no rights reserved
proprietary | 30 | proprietary | proprietary and confidential|confidential and proprietary
proprietary | 35 | proprietary | proprietary (?:software|information|licen[sc]e)
proprietary | 35 | strictly prohibited | unauthorized (?:copying|use|distribution|reproduction)(?: of this [^ ]+)?(?: via any medium)? is strictly prohibited
proprietary | 40 | permission | (?:may not|shall not|no part of this [^ ]+ may) be (?:reproduced|copied|distributed)(?: [^ ]+){0,12} without(?: the)?(?: express)?(?: prior)?(?: written)? permission
proprietary | 40 | permission | without(?: the)?(?: express)? prior written permission of
eula | 45 | license agreement | end user license agreement(?: eula)?
eula | 60 | license agreement | (?:software|master|commercial) license agreement
eula | 60 | licen | by (?:installing|using|downloading)(?: or [^ ]+)? (?:this|the) (?:software|product|program) you (?:agree|accept)(?: [^ ]+){0,10} licen[sc]e
non-commercial | 55 | noncommercial | for noncommercial (?:use|purposes) only|noncommercial (?:use )?licen[sc]e
non-commercial | 55 | non commercial | for non commercial (?:use|purposes) only|non commercial (?:use )?licen[sc]e
evaluation | 55 | evaluation licen | evaluation licen[sc]e
evaluation | 55 | trial licen | trial licen[sc]e
dual | 55 | licensed | dual licensed|(?:is )?licensed under either of
open-source | 65 | open source licen | (?:an |osi approved )?open source licen[sc]e
warranty-disclaimer | 80 | warrant | without(?: any)? warrant(?:y|ies) of any kind
warranty-disclaimer | 80 | warrant | without(?: even the)?(?: implied)? warranty of merchantability
warranty-disclaimer | 82 | warrant | provided as is(?: and)?(?: without)?(?: any)?(?: express or implied)? warranties
license-notice | 90 | license for | see the (?:gnu )?(?:[^ ]+ ){0,5}license for (?:more|further|the) (?:details|specific language|information)
license-notice | 92 | copy of the | you should have received a copy of the (?:[^ ]+ ){0,6}license
license-notice | 94 | license file | see(?: the)?(?: accompanying)? license file
license-notice | 94 | license | license (?:file )?in the (?:project )?root
license-notice | 95 | licensed under | (?:is |are )?licensed under
license-notice | 96 | licen | (?:released|distributed|available|published) under (?:the |a |an )?(?:terms of )?(?:the )?(?:[^ ]+ ){0,3}licen[sc]e
license-notice | 97 | license terms | license terms(?: and conditions)?
license-notice | 97 | license | terms of (?:the |this )license
license-notice | 97 | spdx license identifier | spdx license identifier [^ ]+
"""

# label, name as it is written, identifier, versions ("" for any)
FAMILIES = [
    ("apache", "apache", "apache", ["1 0", "1 1", "2 0", ""]), ("mit", "mit", "mit", [""]), ("bsd", "bsd", "bsd", ["2 clause", "3 clause", "4 clause", ""]),
    ("gpl", "gnu general public", "gpl", ["1", "2", "3", ""]), ("lgpl", "gnu lesser general public", "lgpl", ["2 1", "3", ""]),
    ("agpl", "gnu affero general public", "agpl", ["3", ""]), ("gfdl", "gnu free documentation", "gfdl", ["1 1", "1 2", "1 3", ""]),
    ("mpl", "mozilla public", "mpl", ["1 1", "2 0", ""]), ("epl", "eclipse public", "epl", ["1 0", "2 0", ""]),
    ("cddl", "common development and distribution", "cddl", ["1 0", "1 1", ""]), ("eupl", "european union public", "eupl", ["1 1", "1 2", ""]),
    ("isc", "isc", "isc", [""]), ("zlib", "zlib", "zlib", [""]), ("boost", "boost software", "bsl", ["1 0", ""]), ("unlicense", "unlicense", "unlicense", [""]),
    ("postgresql", "postgresql", "postgresql", [""]), ("ofl", "sil open font", "ofl", ["1 1", ""]), ("artistic", "artistic", "artistic", ["2 0", ""]),
    ("odbl", "open database", "odbl", ["1 0", ""]), ("cc0", "creative commons zero", "cc0", ["1 0", ""]), ("cc-by", "creative commons attribution", "cc by", ["3 0", "4 0", ""]),
]
COMMONS = ["by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"]
COMMONS_VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0", ""]


def _weight(priority: int) -> float:
    return 1.0 if priority <= 15 else 0.8 if priority <= 30 else 0.5 if priority <= 60 else 0.3


def written() -> list[Rule]:
    """The rules written by hand."""
    rows = [[part.strip() for part in line.split(" | ", 3)] for line in WRITTEN.strip().splitlines()]
    return [Rule(keyword, pattern, label, int(priority), _weight(int(priority))) for label, priority, keyword, pattern in rows]


def _tag(label: str, version: str) -> str:
    return f"{label}-{version.replace(' ', '-' if 'clause' in version else '.')}" if version else label


def templates() -> list[Rule]:
    """Rules that follow from names and versions: the usual sentence, the SPDX tag, and short forms of creative commons."""
    out = []
    for label, name, short, versions in FAMILIES:
        for version in versions:
            number, later = f" (?:version |v )?{version}" if version else "", 0 if version else 5
            sentence = f"(?:licensed|released|distributed|available|published|covered) under (?:the )?(?:terms of )?(?:the )?{name} license{number}(?: or later)?"
            out.append(Rule(f"{name} license", sentence, _tag(label, version), 10 + later, 1.0))
            tag = f"spdx license identifier {short}{' ' + version if version else ''}(?: 0)?(?: only| or later)?"
            out.append(Rule("spdx license identifier", tag, _tag(label, version), 5 + later, 1.0))
    for short in COMMONS:
        for version in COMMONS_VERSIONS:
            label, number, later = "cc-" + short.replace(" ", "-"), f" {version}" if version else "", 0 if version else 5
            out.append(Rule(f"cc {short}", f"(?:licensed under (?:a |the )?)?cc {short}{number}(?: license)?", _tag(label, version), 20 + later, 0.8))
            if version:
                out.append(Rule("creativecommons org licenses", f"creativecommons org licenses {short}{number}", _tag(label, version), 8, 1.0))
    return out


def rules() -> list[Rule]:
    return written() + templates()
