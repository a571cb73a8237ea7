"""Signature rules of licences, in order of priority.

A line has a label, a strength, the words that must be in a text for the rule to be
tried, and a regular expression over normalised words (lower case, single spaces, so
"2.0" reads "2 0" and "BY-NC" reads "by nc"). Strengths: ``text`` is wording of the
licence or of its notice, ``tag`` an identifier, ``url`` an address, ``name`` the name
with its version, ``hint`` a name alone or a general remark.
"""

from __future__ import annotations

import re
from typing import NamedTuple

STRENGTH = {"text": 1.0, "tag": 0.95, "url": 0.9, "name": 0.8, "hint": 0.5}

RULES_TEXT = r"""
# wording and notices
apache-2.0 | text | apache,compliance | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2.0 | text | apache,obtain | you may obtain a copy of the license at https? www apache org licenses license 2 0
apache-2.0 | text | terms,reproduction | terms and conditions for use reproduction and distribution 1 definitions
apache-2.0 | text | express,governing | distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions
mit | text | hereby,sublicense | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: the software)? to deal in the software without restriction
mit | text | merge,publish,sublicense | rights to use copy modify merge publish distribute sublicense and or sell copies of the software
mit | text | substantial,portions | the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software
mit-0 | text | hereby,persons | permission is hereby granted free of charge to any person obtaining a copy of this software .{0,200}?sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
mit | text | noninfringement,tort | in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise
x11 | text | consortium | except as contained in this notice the name of the x consortium shall not be used in advertising
bsd-4-clause | text | advertising,features | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-3-clause | text | endorse,promote | neither the names? of (?:[^ ]+ ){1,12}nor the names of (?:its|their|the) contributors may be used to endorse or promote products
bsd-3-clause-clear | text | patent,clear | no express or implied licenses to any partys patent rights are granted by this license
bsd-2-clause | text | redistributions,binary | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer(?: \d)? redistributions in binary form must reproduce
bsd | text | redistribution,binary | redistribution and use in source and binary forms with or without modification are permitted
isc | text | fee,hereby | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
0bsd | text | fee,hereby | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
agpl-3.0-or-later | text | affero,later | terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
lgpl-3.0-or-later | text | lesser,later | terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
lgpl-2.1-or-later | text | lesser,later | terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
lgpl-2.0-or-later | text | library,later | terms of the gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-3.0-or-later | text | gnu,later | terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-2.0-or-later | text | gnu,later | terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-1.0-or-later | text | gnu,later | terms of the gnu general public license as published by the free software foundation either version 1 or at your option any later version
gpl-3.0-only | text | gnu | terms of the gnu general public license version 3 as published by the free software foundation
gpl-2.0-only | text | gnu | terms of the gnu general public license version 2 as published by the free software foundation
gpl | text | merchantability,gnu | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu (?:affero |lesser )?general public license for more details
gpl | text | received,gnu | you should have received a copy of the gnu general public license along with this program
lgpl | text | received,lesser | you should have received a copy of the gnu lesser general public license along with this (?:library|program)
agpl | text | received,affero | you should have received a copy of the gnu affero general public license along with this program
agpl-3.0 | text | remote,interact | your modified version must prominently offer all users interacting with it remotely through a computer network
mpl-2.0 | text | mozilla,subject | this source code form is subject to the terms of the mozilla public license v(?:ersion)? ?2 0
mpl-1.1 | text | mozilla,subject | the contents of this file are subject to the mozilla public license version 1 1
epl-2.0 | text | eclipse,accompanying | accompanying materials are made available under the terms of the eclipse public license (?:v |version )?2 0
epl-1.0 | text | eclipse,accompanying | accompanying materials are made available under the terms of the eclipse public license v(?:ersion)? ?1 0
cddl-1.0 | text | cddl,subject | subject to the terms of the common development and distribution license(?: version 1 0)?(?: only)?(?: the license)?
cpl-1.0 | text | common,accompanying | accompanying materials are made available under the terms of the common public license v1 0
bsl-1.0 | text | boost,distributed | distributed under the boost software license version 1 0
zlib | text | altered,misrepresented | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib | text | origin,misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
unlicense | text | unencumbered,domain | this is free and unencumbered software released into the public domain
wtfpl | text | fuck,want | you just do what the fuck you want to
beerware | text | beer,retain | as long as you retain this notice you can do whatever you want with this stuff
cc0-1.0 | text | waived,extent | to the extent possible under law .{0,120}?waived all copyright and related or neighboring rights
pddl-1.0 | text | dedicates,domain | the rightsholder hereby dedicates .{0,120}?to the public domain
ofl-1.1 | text | sil,font | this font software is licensed under the sil open font license version 1 1
ofl-1.1 | text | reserved,font | no modified version of the font software may use the reserved font name
gfdl-1.3 | text | documentation,invariant | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 3
gfdl-1.2 | text | documentation,invariant | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 2
gfdl-1.1 | text | documentation,invariant | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 1
gfdl | text | invariant,texts | with no invariant sections no front cover texts and no back cover texts
psf-2.0 | text | psf,nonexclusive | psf hereby grants licensee a nonexclusive royalty free world wide license
openssl | text | openssl,toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
php-3.01 | text | php,subject | this source file is subject to version 3 01 of the php license
php-3.0 | text | php,subject | this source file is subject to version 3 0 of the php license
python-2.0 | text | beopen,grants | beopen hereby grants licensee a non exclusive royalty free world wide license
artistic-1.0 | text | artistic,semblance | copyright holder maintains some semblance of artistic control over the development of the package
ms-pl | text | contributor,grants,microsoft | microsoft public license .{0,120}?this license governs use of the accompanying software
curl | text | fee,hereby,curl | curl .{0,200}?permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted
ncsa | text | ncsa,illinois | developed by .{0,120}?university of illinois
postgresql | text | california,written | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
hpnd | text | hereby,supporting | permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee
sspl-1.0 | text | server,side | make the functionality of the program or a modified version available to third parties as a service
elastic-2.0 | text | hosted,managed | you may not provide the software to third parties as a hosted or managed service
busl-1.1 | text | change,production | the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use
commons-clause | text | sell,clause | the grant of rights under the license will not include and the license does not grant to you the right to sell the software
openrail | text | behavioral,restrictions | use based restrictions as referenced in paragraph 5
proprietary | text | confidential,proprietary | (?:this (?:file|software|document|material) (?:is|contains) )?(?:confidential and proprietary|proprietary and confidential)(?: information)?
proprietary | text | reproduced,written | (?:may not|must not|shall not) be (?:copied |reproduced |distributed |or ){1,6}(?:in (?:whole|any form) (?:or in part )?)?without (?:the )?(?:prior |express )*written (?:permission|consent)
proprietary | text | unauthorized,copying | unauthorized copying of this (?:file|software|document) via any medium is strictly prohibited
public-domain | text | dedicated,domain | (?:hereby )?(?:dedicated|released|placed) (?:in|to|into) the public domain
crown-copyright | text | crown,copyright | (?:contains public sector information licensed under the open government licence|crown copyright(?: reserved)?)
# identifiers
apache-2.0 | tag | spdx,apache | spdx license identifier apache 2 0
mit | tag | spdx,mit | spdx license identifier mit
mit-0 | tag | spdx,mit | spdx license identifier mit 0
bsd-2-clause | tag | spdx,bsd | spdx license identifier bsd 2 clause
bsd-3-clause | tag | spdx,bsd | spdx license identifier bsd 3 clause
bsd-4-clause | tag | spdx,bsd | spdx license identifier bsd 4 clause
0bsd | tag | spdx,0bsd | spdx license identifier 0bsd
isc | tag | spdx,isc | spdx license identifier isc
gpl-2.0-only | tag | spdx,gpl | spdx license identifier gpl 2 0(?: only)?
gpl-2.0-or-later | tag | spdx,gpl | spdx license identifier gpl 2 0 or later
gpl-3.0-only | tag | spdx,gpl | spdx license identifier gpl 3 0(?: only)?
gpl-3.0-or-later | tag | spdx,gpl | spdx license identifier gpl 3 0 or later
lgpl-2.1-only | tag | spdx,lgpl | spdx license identifier lgpl 2 1(?: only)?
lgpl-2.1-or-later | tag | spdx,lgpl | spdx license identifier lgpl 2 1 or later
lgpl-3.0-only | tag | spdx,lgpl | spdx license identifier lgpl 3 0(?: only)?
lgpl-3.0-or-later | tag | spdx,lgpl | spdx license identifier lgpl 3 0 or later
agpl-3.0-only | tag | spdx,agpl | spdx license identifier agpl 3 0(?: only)?
agpl-3.0-or-later | tag | spdx,agpl | spdx license identifier agpl 3 0 or later
mpl-1.1 | tag | spdx,mpl | spdx license identifier mpl 1 1
mpl-2.0 | tag | spdx,mpl | spdx license identifier mpl 2 0
epl-1.0 | tag | spdx,epl | spdx license identifier epl 1 0
epl-2.0 | tag | spdx,epl | spdx license identifier epl 2 0
cddl-1.0 | tag | spdx,cddl | spdx license identifier cddl 1 0
bsl-1.0 | tag | spdx,bsl | spdx license identifier bsl 1 0
zlib | tag | spdx,zlib | spdx license identifier zlib
unlicense | tag | spdx,unlicense | spdx license identifier unlicense
wtfpl | tag | spdx,wtfpl | spdx license identifier wtfpl
cc0-1.0 | tag | spdx,cc0 | spdx license identifier cc0 1 0
cc-by-4.0 | tag | spdx,cc | spdx license identifier cc by 4 0
cc-by-sa-4.0 | tag | spdx,cc | spdx license identifier cc by sa 4 0
ofl-1.1 | tag | spdx,ofl | spdx license identifier ofl 1 1
artistic-2.0 | tag | spdx,artistic | spdx license identifier artistic 2 0
postgresql | tag | spdx,postgresql | spdx license identifier postgresql
python-2.0 | tag | spdx,python | spdx license identifier python 2 0
ncsa | tag | spdx,ncsa | spdx license identifier ncsa
upl-1.0 | tag | spdx,upl | spdx license identifier upl 1 0
eupl-1.2 | tag | spdx,eupl | spdx license identifier eupl 1 2
other-spdx | tag | spdx,identifier | spdx license identifier [^ ]+
mit | tag | osi,mit | license osi approved mit license
apache-2.0 | tag | osi,apache | license osi approved apache software license
bsd | tag | osi,bsd | license osi approved bsd license
gpl-3.0 | tag | osi,gplv3 | license osi approved gnu general public license v3(?: or later)? gplv3
gpl-2.0 | tag | osi,gplv2 | license osi approved gnu general public license v2(?: or later)? gplv2
mpl-2.0 | tag | osi,mozilla | license osi approved mozilla public license 2 0
proprietary | tag | license,proprietary | license other proprietary license
# addresses
apache-2.0 | url | apache,licenses | apache org licenses license 2 0
gpl-3.0 | url | gnu,licenses | gnu org (?:licenses|copyleft) gpl 3 0
gpl-2.0 | url | gnu,licenses | gnu org licenses (?:old licenses )?gpl 2 0
gpl | url | gnu,licenses | gnu org (?:licenses|copyleft) gpl
lgpl-3.0 | url | gnu,licenses | gnu org (?:licenses|copyleft) lgpl 3 0
lgpl-2.1 | url | gnu,licenses | gnu org licenses (?:old licenses )?lgpl 2 1
agpl-3.0 | url | gnu,licenses | gnu org licenses agpl 3 0
gfdl-1.3 | url | gnu,licenses | gnu org (?:licenses|copyleft) fdl(?: 1 3)?
mpl-2.0 | url | mozilla,mpl | mozilla org mpl 2 0
mpl-1.1 | url | mozilla,mpl | mozilla org mpl 1 1
mit | url | opensource,mit | opensource org licen[sc]es? mit(?: license)?
bsd-3-clause | url | opensource,bsd | opensource org licenses bsd 3 clause
bsd-2-clause | url | opensource,bsd | opensource org licenses bsd 2 clause
isc | url | opensource,isc | opensource org licenses isc
artistic-2.0 | url | opensource,artistic | opensource org licenses artistic(?: license)? 2 0
epl-2.0 | url | eclipse,epl | eclipse org legal epl (?:2 0|v20)
epl-1.0 | url | eclipse,epl | eclipse org legal epl v10
bsl-1.0 | url | boost,license | boost org license 1 0
unlicense | url | unlicense,org | unlicense org
ofl-1.1 | url | sil,ofl | scripts sil org ofl
eupl-1.2 | url | europa,eupl | europa eu .{0,80}?eupl
ogl-uk-3.0 | url | nationalarchives,licence | nationalarchives gov uk doc open government licence version 3
odbl-1.0 | url | opendatacommons,odbl | opendatacommons org licenses odbl
odc-by-1.0 | url | opendatacommons,by | opendatacommons org licenses by
pddl-1.0 | url | opendatacommons,pddl | opendatacommons org licenses pddl
cc0-1.0 | url | creativecommons,zero | creativecommons org publicdomain zero 1 0
public-domain | url | creativecommons,mark | creativecommons org publicdomain mark 1 0
# creative commons
%cc
cc0-1.0 | name | cc0 | cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?
cc0-1.0 | name | creative,zero | creative commons zero(?: v1 0)?
cc-sampling | name | sampling,commons | creative commons sampling(?: plus)?(?: 1 0)?
cc | hint | creative,commons | (?:under |with |a )?(?:the |a )?creative commons(?: attribution)? licen[sc]e
# names with versions
apache-2.0 | name | apache | apache (?:software )?(?:public )?licen[sc]e(?: v| version)? ?2(?: 0)?
apache-1.1 | name | apache | apache (?:software )?licen[sc]e(?: v| version)? ?1 1
apache-1.0 | name | apache | apache (?:software )?licen[sc]e(?: v| version)? ?1 0
apache-2.0 | name | asl | asl 2 0
agpl-3.0 | name | affero | (?:gnu )?affero (?:general public licen[sc]e|gpl)(?: agpl)?(?: v| version)? ?3(?: 0)?
lgpl-3.0 | name | lesser | (?:gnu )?lesser general public licen[sc]e(?: lgpl)?(?: v| version)? ?3(?: 0)?
lgpl-2.1 | name | lesser | (?:gnu )?lesser general public licen[sc]e(?: lgpl)?(?: v| version)? ?2 1
lgpl-2.0 | name | library | (?:gnu )?library general public licen[sc]e(?: lgpl)?(?: v| version)? ?2(?: 0)?
gpl-3.0 | name | general,public | (?:gnu )?general public licen[sc]e(?: gpl)?(?: v| version)? ?3(?: 0)?
gpl-2.0 | name | general,public | (?:gnu )?general public licen[sc]e(?: gpl)?(?: v| version)? ?2(?: 0)?
gpl-1.0 | name | general,public | (?:gnu )?general public licen[sc]e(?: gpl)?(?: v| version)? ?1(?: 0)?
agpl-3.0 | name | agpl | (?:gnu )?agpl(?: v| version)? ?3(?: 0)?
lgpl-3.0 | name | lgpl | (?:gnu )?lgpl(?: v| version)? ?3(?: 0)?
lgpl-2.1 | name | lgpl | (?:gnu )?lgpl(?: v| version)? ?2 1
gpl-3.0 | name | gpl | (?:gnu )?gpl(?: v| version)? ?3(?: 0)?
gpl-2.0 | name | gpl | (?:gnu )?gpl(?: v| version)? ?2(?: 0)?
agpl-3.0 | name | agplv3 | (?:gnu )?agplv3
lgpl-3.0 | name | lgplv3 | (?:gnu )?lgplv3
lgpl-2.1 | name | lgplv2 | (?:gnu )?lgplv2(?: 1)?
gpl-3.0 | name | gplv3 | (?:gnu )?gplv3
gpl-2.0 | name | gplv2 | (?:gnu )?gplv2
gpl-classpath | name | classpath,exception | (?:gpl(?: v?2(?: 0)?)? )?with (?:the )?classpath exception
gcc-exception | name | gcc,exception | gcc runtime library exception
mpl-2.0 | name | mozilla | mozilla public licen[sc]e(?: mpl)?(?: v| version)? ?2(?: 0)?
mpl-1.1 | name | mozilla | mozilla public licen[sc]e(?: mpl)?(?: v| version)? ?1 1
mpl-1.0 | name | mozilla | mozilla public licen[sc]e(?: mpl)?(?: v| version)? ?1 0
mpl-2.0 | name | mpl | mpl (?:v|version )?2 0
epl-2.0 | name | eclipse | eclipse public licen[sc]e(?: epl)?(?: v| version)? ?2(?: 0)?
epl-1.0 | name | eclipse | eclipse public licen[sc]e(?: epl)?(?: v| version)? ?1(?: 0)?
edl-1.0 | name | eclipse | eclipse distribution licen[sc]e(?: v| version)? ?1 0
cddl-1.1 | name | cddl | (?:common development and distribution licen[sc]e )?cddl (?:v|version )?1 1
cddl-1.0 | name | cddl | (?:common development and distribution licen[sc]e )?cddl (?:v|version )?1 0
bsd-4-clause | name | bsd | (?:original|4 clause|four clause) bsd(?: licen[sc]e)?
bsd-3-clause | name | bsd | (?:new|modified|revised|3 clause|three clause) bsd(?: licen[sc]e)?
bsd-2-clause | name | bsd | (?:simplified|freebsd|2 clause|two clause) bsd(?: licen[sc]e)?
bsd-1-clause | name | bsd | (?:1 clause|one clause) bsd(?: licen[sc]e)?
bsd-4-clause | name | bsd | bsd 4 clause(?: licen[sc]e)?
bsd-3-clause | name | bsd | bsd 3 clause(?: licen[sc]e)?
bsd-2-clause | name | bsd | bsd 2 clause(?: licen[sc]e)?
bsd-2-clause-patent | name | bsd,patent | bsd (?:2 clause )?(?:plus )?patent(?: licen[sc]e)?
artistic-2.0 | name | artistic | artistic licen[sc]e(?: v| version)? ?2(?: 0)?
artistic-1.0 | name | artistic | artistic licen[sc]e(?: v| version)? ?1(?: 0)?
bsl-1.0 | name | boost | boost software licen[sc]e(?: bsl)?(?: v| version)? ?1?(?: 0)?
zlib | name | zlib | zlib(?: libpng)? licen[sc]e
libpng | name | libpng | libpng licen[sc]e(?: v| version)?(?: ?2)?
openldap | name | openldap | openldap public licen[sc]e(?: v| version)?(?: ?2 8)?
openssl | name | openssl | openssl licen[sc]e
php-3.01 | name | php | php licen[sc]e(?: v| version)? ?3 01
python-2.0 | name | python | python(?: software foundation)? licen[sc]e(?: v| version)?(?: ?2(?: 0)?)?
ruby | name | ruby | ruby licen[sc]e
vim | name | vim | vim licen[sc]e
tcl | name | tcl | tcl (?:tk )?licen[sc]e
x11 | name | x11 | x11 licen[sc]e
postgresql | name | postgresql | postgresql licen[sc]e
qpl-1.0 | name | qt | q(?:t)? public licen[sc]e(?: v| version)?(?: ?1 0)?
ncsa | name | illinois | university of illinois ncsa open source licen[sc]e
afl-3.0 | name | academic | academic free licen[sc]e(?: afl)?(?: v| version)?(?: ?3 0)?
osl-3.0 | name | open | open software licen[sc]e(?: osl)?(?: v| version)?(?: ?3 0)?
ecl-2.0 | name | educational | educational community licen[sc]e(?: v| version)?(?: ?2 0)?
upl-1.0 | name | universal | universal permissive licen[sc]e(?: upl)?(?: v| version)?(?: ?1 0)?
eupl-1.2 | name | european | european union public licen[sc]e(?: eupl)?(?: v| version)? ?1 2
eupl-1.1 | name | european | european union public licen[sc]e(?: eupl)?(?: v| version)? ?1 1
cecill-2.1 | name | cecill | cecill(?: free software licen[sc]e)?(?: agreement)?(?: v| version)? ?2 1
cecill-b | name | cecill | cecill b
cecill-c | name | cecill | cecill c
mulan-psl-2.0 | name | mulan | mulan (?:permissive software licen[sc]e|psl)(?: v?2)?
ms-pl | name | microsoft | microsoft public licen[sc]e(?: ms pl)?
ms-rl | name | microsoft | microsoft reciprocal licen[sc]e(?: ms rl)?
ibm-pl-1.0 | name | ibm | ibm public licen[sc]e(?: v| version)?(?: ?1 0)?
cpl-1.0 | name | common | common public licen[sc]e(?: v| version)?(?: ?1 0)?
lppl-1.3c | name | latex | latex project public licen[sc]e(?: lppl)?(?: v| version)?(?: ?1 3c?)?
npl-1.1 | name | netscape | netscape public licen[sc]e(?: v| version)?(?: ?1 [01])?
spl-1.0 | name | sun | sun public licen[sc]e(?: v| version)?(?: ?1 0)?
apsl-2.0 | name | apple | apple public source licen[sc]e(?: v| version)?(?: ?2(?: 0)?)?
rpl-1.5 | name | reciprocal | reciprocal public licen[sc]e(?: v| version)?(?: ?1 5)?
w3c | name | w3c | w3c (?:software )?(?:notice and )?licen[sc]e
unicode | name | unicode | unicode (?:licen[sc]e|terms of use)(?: v?3)?
icu | name | icu | icu licen[sc]e
ijg | name | jpeg | independent jpeg group licen[sc]e
ofl-1.1 | name | font | (?:sil )?open font licen[sc]e(?: ofl)?(?: v| version)?(?: ?1 1)?
gfdl-1.3 | name | documentation | (?:gnu )?free documentation licen[sc]e(?: gfdl)?(?: v| version)? ?1 3
gfdl-1.2 | name | documentation | (?:gnu )?free documentation licen[sc]e(?: gfdl)?(?: v| version)? ?1 2
gfdl | name | documentation | (?:gnu )?free documentation licen[sc]e(?: gfdl)?
odbl-1.0 | name | database | open (?:data commons open )?database licen[sc]e(?: odbl)?(?: v?1 0)?
odc-by-1.0 | name | commons | open data commons attribution licen[sc]e(?: v?1 0)?
pddl-1.0 | name | commons | open data commons public domain dedication and licen[sc]e
cdla-permissive-2.0 | name | community,permissive | community data licen[sc]e agreement permissive(?: version)?(?: 2 0)?
cdla-sharing-1.0 | name | community,sharing | community data licen[sc]e agreement sharing(?: version)?(?: 1 0)?
ogl-uk-3.0 | name | government | open government licen[sc]e(?: v| version)? ?3(?: 0)?
ogl-uk-2.0 | name | government | open government licen[sc]e(?: v| version)? ?2(?: 0)?
etalab-2.0 | name | etalab | (?:licence ouverte|open licence)(?: etalab)?(?: v?2 0)?
dl-de-by-2.0 | name | datenlizenz | datenlizenz deutschland namensnennung(?: version)?(?: 2 0)?
dl-de-zero-2.0 | name | datenlizenz | datenlizenz deutschland zero(?: version)?(?: 2 0)?
free-art-1.3 | name | art | (?:free art licen[sc]e|licence art libre)(?: 1 3)?
sspl-1.0 | name | server | server side public licen[sc]e(?: sspl)?(?: v?1)?
busl-1.1 | name | business | business source licen[sc]e(?: busl| bsl)?(?: v?1 1)?
elastic-2.0 | name | elastic | elastic licen[sc]e(?: v?2(?: 0)?)?
polyform | name | polyform | polyform (?:noncommercial|small business|shield|strict|free trial)(?: licen[sc]e)?(?: 1 0 0)?
commons-clause | name | commons,clause | commons clause(?: licen[sc]e)?(?: condition)?(?: v?1 0)?
hippocratic | name | hippocratic | hippocratic licen[sc]e(?: v?\d(?: \d)?)?
openrail-m | name | openrail | (?:creativeml |bigscience )?open ?rail(?: (?:m|pp|s))*(?: licen[sc]e)?
json | name | json | json licen[sc]e
blueoak-1.0.0 | name | oak | blue oak model licen[sc]e(?: 1 0 0)?
wtfpl | name | wtfpl | wtfpl(?: v?2)?
beerware | name | beer | beer ?ware licen[sc]e
unlicense | name | unlicense | the unlicense
isc | name | isc | isc licen[sc]e
mit | name | mit | (?:the )?(?:mit|expat) licen[sc]e
0bsd | name | 0bsd | 0bsd(?: licen[sc]e)?
# names alone and remarks
apache | hint | apache | (?:the )?apache (?:software )?licen[sc]e
agpl | hint | affero | (?:gnu )?affero general public licen[sc]e
lgpl | hint | lesser | (?:gnu )?lesser general public licen[sc]e
agpl | hint | agpl | (?:gnu )?agpl
lgpl | hint | lgpl | (?:gnu )?lgpl
gpl | hint | gpl | (?:gnu )?gpl(?: licen[sc]ed?)?
gpl | hint | gnu | gnu general public licen[sc]e
bsd | hint | bsd | (?:under )?(?:the |a )?bsd(?: style)? licen[sc]e
mpl | hint | mozilla | mozilla public licen[sc]e
epl | hint | eclipse | eclipse public licen[sc]e
artistic | hint | artistic | artistic licen[sc]e
eupl | hint | european | european union public licen[sc]e
cddl | hint | distribution | common development and distribution licen[sc]e
ogl | hint | government | open government licen[sc]e
mit | hint | mit | (?:licensed|released|available|distributed) under (?:the )?(?:terms of )?(?:the )?mit
apache | hint | apache | (?:licensed|released|available|distributed) under (?:the )?(?:terms of )?(?:the )?apache(?: 2(?: 0)?)?
permissive | hint | permissive | permissive(?:ly)? licen[sc](?:e|ed)
copyleft | hint | copyleft | (?:strong |weak )?copyleft(?: licen[sc]e)?
dual | hint | dual | dual licen[sc](?:e|ed|ing)
freeware | hint | freeware | freeware(?: licen[sc]e)?
shareware | hint | shareware | shareware(?: licen[sc]e)?
noncommercial | hint | commercial | (?:for )?(?:personal (?:and|or) )?non commercial (?:use|purposes)(?: only)?
noncommercial | hint | noncommercial | (?:for )?noncommercial (?:use|purposes)(?: only)?
evaluation | hint | evaluation | for evaluation purposes only
research-only | hint | research | for (?:academic |scientific )?research (?:use|purposes) only
eula | hint | eula | (?:this )?eula
eula | hint | end,user | end user licen[sc]e agreement
redistribution-forbidden | hint | redistribute | (?:may|must|do) not (?:copy or )?redistribute
public-domain | hint | domain | (?:is |are )?in the public domain
copyright | hint | copyright | copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)?\d\d)?
proprietary | hint | proprietary | proprietary (?:licen[sc]e|software)
"""

#: Parts of Creative Commons names: (in the label, as letters, in words).
_CC = [("by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
       ("by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s(?: works)?"),
       ("by-nc", "by nc", "attribution non ?commercial"), ("by-sa", "by sa", "attribution share ?alike"),
       ("by-nd", "by nd", "attribution no ?deriv(?:ative)?s(?: works)?"), ("by", "by", "attribution")]
_CC_VERSIONS = ["4.0", "3.0", "2.5", "2.0", "1.0"]


def _creative_commons() -> list[str]:
    """Address, letters and words of every combination and version, the longer combinations first."""
    out = []
    for part, letters, words in _CC:
        for version in _CC_VERSIONS:
            v, label = version.replace(".", " "), f"cc-{part}-{version}"
            out += [f"{label} | url | creativecommons | creativecommons org licenses {letters} {v}",
                    f"{label} | name | cc | cc {letters}(?: (?:v|version))? ?{v}",
                    f"{label} | name | attribution | creative commons {words}(?: licen[sc]e)?(?: {v}| version {v})"]
    for part, letters, words in _CC:
        out += [f"cc-{part} | url | creativecommons | creativecommons org licenses {letters}",
                f"cc-{part} | hint | cc | cc {letters}(?: licen[sc]e)?",
                f"cc-{part} | hint | attribution | creative commons {words}(?: licen[sc]e)?"]
    return out


class Rule(NamedTuple):
    name: str
    label: str
    weight: float
    words: tuple[str, ...]
    pattern: re.Pattern


def read_rules(text: str = RULES_TEXT) -> list[Rule]:
    """Rules in order; the first has the highest priority."""
    lines = [x for x in text.strip().splitlines() if not x.startswith("#")]
    at = lines.index("%cc") if "%cc" in lines else None
    if at is not None:
        lines[at:at + 1] = _creative_commons()
    out = []
    for i, line in enumerate(lines):
        label, strength, words, pattern = (x.strip() for x in line.split(" | "))
        out.append(Rule(f"{label}:{strength}:{i}", label, STRENGTH[strength], tuple(words.split(",")),
                        re.compile(f"(?<![^ ])(?:{pattern})(?![^ ])")))
    return out
