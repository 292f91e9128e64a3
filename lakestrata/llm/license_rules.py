"""Signature rules of the license scan, written by hand and in order of priority.

One rule a line: label, form, regular expression. Expressions stand for
normalised text (letter words in lower case, one space between), are anchored at
word borders and have a bounded length. An earlier line wins over a later one,
so of two names that overlap the special one stands first. Forms: `id` (tags and
identifiers), `text` (sentences of a license), `notice` (what grants one),
`link` (addresses), `name`, `short` (short names with a version), `reserved`.
"""

RULES = r"""
agpl id (?:spdx )?licen[cs]e identifier agpl \d \d(?: only| or later)?
lgpl id (?:spdx )?licen[cs]e identifier lgpl \d \d(?: only| or later)?
gpl id (?:spdx )?licen[cs]e identifier gpl \d \d(?: only| or later)?(?: with [a-z]{1,40} exception)?
gfdl id (?:spdx )?licen[cs]e identifier gfdl \d \d(?: only| or later)?
apache id (?:spdx )?licen[cs]e identifier apache \d \d(?: with llvm exception)?
mit-0 id (?:spdx )?licen[cs]e identifier mit 0
mit id (?:spdx )?licen[cs]e identifier mit
bsd-0-clause id (?:spdx )?licen[cs]e identifier 0bsd
bsd-2-clause id (?:spdx )?licen[cs]e identifier bsd 2 clause(?: patent)?
bsd-3-clause id (?:spdx )?licen[cs]e identifier bsd 3 clause(?: clear| lbnl)?
bsd-4-clause id (?:spdx )?licen[cs]e identifier bsd 4 clause
isc id (?:spdx )?licen[cs]e identifier isc
zlib id (?:spdx )?licen[cs]e identifier zlib
mpl id (?:spdx )?licen[cs]e identifier mpl \d \d
epl id (?:spdx )?licen[cs]e identifier epl \d \d
cddl id (?:spdx )?licen[cs]e identifier cddl \d \d
eupl id (?:spdx )?licen[cs]e identifier eupl \d \d
artistic id (?:spdx )?licen[cs]e identifier artistic \d \d
boost id (?:spdx )?licen[cs]e identifier bsl 1 0
bsl id (?:spdx )?licen[cs]e identifier busl 1 1
python id (?:spdx )?licen[cs]e identifier (?:psf|python) 2 0
php id (?:spdx )?licen[cs]e identifier php 3 0\d?
ruby id (?:spdx )?licen[cs]e identifier ruby
openssl id (?:spdx )?licen[cs]e identifier openssl
postgresql id (?:spdx )?licen[cs]e identifier postgresql
wtfpl id (?:spdx )?licen[cs]e identifier wtfpl
unlicense id (?:spdx )?licen[cs]e identifier unlicense
ms-pl id (?:spdx )?licen[cs]e identifier ms pl
ms-rl id (?:spdx )?licen[cs]e identifier ms rl
ofl id (?:spdx )?licen[cs]e identifier ofl 1 \d
odbl id (?:spdx )?licen[cs]e identifier odbl 1 0
odc-by id (?:spdx )?licen[cs]e identifier odc by 1 0
pddl id (?:spdx )?licen[cs]e identifier pddl 1 0
cdla id (?:spdx )?licen[cs]e identifier cdla (?:permissive|sharing) \d \d
cc0 id (?:spdx )?licen[cs]e identifier cc0 1 0
cc-by-nc-sa id (?:spdx )?licen[cs]e identifier cc by nc sa \d \d
cc-by-nc-nd id (?:spdx )?licen[cs]e identifier cc by nc nd \d \d
cc-by-nc id (?:spdx )?licen[cs]e identifier cc by nc \d \d
cc-by-sa id (?:spdx )?licen[cs]e identifier cc by sa \d \d
cc-by-nd id (?:spdx )?licen[cs]e identifier cc by nd \d \d
cc-by id (?:spdx )?licen[cs]e identifier cc by \d \d
sspl id (?:spdx )?licen[cs]e identifier sspl 1 0
elastic id (?:spdx )?licen[cs]e identifier elastic 2 0
academic id (?:spdx )?licen[cs]e identifier afl \d \d
osl id (?:spdx )?licen[cs]e identifier osl \d \d
ncsa id (?:spdx )?licen[cs]e identifier ncsa
upl id (?:spdx )?licen[cs]e identifier upl 1 0
json id (?:spdx )?licen[cs]e identifier json
vim id (?:spdx )?licen[cs]e identifier vim
beerware id (?:spdx )?licen[cs]e identifier beerware
blue-oak id (?:spdx )?licen[cs]e identifier blueoak 1 0 0
cecill id (?:spdx )?licen[cs]e identifier cecill \d \d
mulan id (?:spdx )?licen[cs]e identifier mulanpsl \d \d
agpl text the gnu affero general public licen[cs]e is a free copyleft licen[cs]e for software and other kinds of works specifically designed to ensure cooperation with the community
agpl text your modified version must prominently offer all users interacting with it remotely through a computer network
agpl text preamble the gnu affero general public licen[cs]e
lgpl text this licen[cs]e the lesser general public licen[cs]e applies to some specially designated software packages
lgpl text this version of the gnu lesser general public licen[cs]e incorporates the terms and conditions of version 3 of the gnu general public licen[cs]e
lgpl text this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e
lgpl text a work that uses the library
gpl text the licen[cs]es for most software are designed to take away your freedom to share and change it
gpl text the gnu general public licen[cs]e is a free copyleft licen[cs]e for software and other kinds of works
gpl text the gnu general public licen[cs]e is intended to guarantee your freedom to share and change
gpl text our general public licen[cs]es are designed to make sure that you have the freedom to distribute copies of free software
gpl text you may copy and distribute verbatim copies of the program s source code as you receive it
gpl text you may convey verbatim copies of the program s source code as you receive it
gpl text you must cause any work that you distribute or publish that in whole or in part contains or is derived from the program
gpl text this general public licen[cs]e does not permit incorporating your program into proprietary programs
gpl notice this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e(?: as published by the free software foundation)?
gpl notice this program is distributed in the hope that it will be useful but without any warranty
gpl notice you should have received a copy of the gnu general public licen[cs]e along with this program
lgpl notice you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e along with this
agpl notice you should have received a copy of the gnu affero general public licen[cs]e along with this
gfdl notice permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e
gfdl text with no invariant sections no front cover texts and no back cover texts
gfdl text the purpose of this licen[cs]e is to make a manual textbook or other functional and useful document free in the sense of freedom
apache notice licen[cs]ed under the apache licen[cs]e version 2 0(?: the licen[cs]e)?
apache notice you may not use this file except in compliance with the licen[cs]e
apache notice you may obtain a copy of the licen[cs]e at http www apache org licen[cs]es licen[cs]e 2 0
apache notice unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis
apache notice licen[cs]ed to the apache software foundation asf under one or more contributor licen[cs]e agreements
apache text subject to the terms and conditions of this licen[cs]e each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright licen[cs]e
apache text you must cause any modified files to carry prominent notices stating that you changed the files
apache text if the work includes a notice text file as part of its distribution
apache text this product includes software developed by the apache (?:software foundation|group)
boost text permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this licen[cs]e
boost text unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor
mit text permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: the software)?
mit text to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicen[cs]e and or sell
mit text the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit text the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
mit text in no event shall the authors or copyright holders be liable for any claim damages or other liability
json text the software shall be used for good not evil
mit notice use of this source code is governed by an mit(?: style)? licen[cs]e
bsd notice use of this source code is governed by a bsd(?: style)? licen[cs]e
ncsa text to deal with the software without restriction including without limitation
ncsa text redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimers
bsd-4-clause text all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment
bsd-3-clause text neither the name of (?:[^ ]{1,40} ){1,12}nor the names of (?:its|his|their|the) contributors may be used to endorse or promote products
bsd-3-clause text the names? of (?:[^ ]{1,40} ){1,12}may not be used to endorse or promote products derived from this software
bsd text redistribution and use in source and binary forms with or without modification are permitted
bsd text redistributions of source code must retain the above copyright notice
bsd text redistributions in binary form must reproduce the above copyright notice
bsd text this software is provided by (?:[^ ]{1,40} ){1,10}as is and any express(?:ed)? or implied warranties
bsd-2-clause text the views and conclusions contained in the software and documentation are those of the authors and should not be interpreted as representing official policies
bsd-3-clause text no express or implied licen[cs]es to any party s patent rights are granted by this licen[cs]e
isc text permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that
bsd-0-clause text permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc text the software is provided as is and the author disclaims all warranties with regard to this software
postgresql text permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
hpnd text permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee
hpnd text permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted
zlib text this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib text permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely
zlib text altered source versions must be plainly marked as such
zlib text the origin of this software must not be misrepresented
libpng text the contributing authors and group 42 inc disclaim all warranties
libpng text the png reference library is supplied as is
mpl notice this source code form is subject to the terms of the mozilla public licen[cs]e
mpl notice the contents of this file are subject to the mozilla public licen[cs]e version 1 \d
mpl notice if a copy of the mpl was not distributed with this file you can obtain one at
mpl text this source code form is incompatible with secondary licen[cs]es as defined by the mozilla public licen[cs]e
epl text the accompanying program is provided under the terms of this eclipse public licen[cs]e
epl notice all rights reserved this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e
epl notice this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e
edl notice made available under the terms of the eclipse distribution licen[cs]e
cpl text the accompanying program is provided under the terms of this common public licen[cs]e
ibm-pl text the accompanying program is provided under the terms of this ibm public licen[cs]e
cddl notice the contents of this file are subject to the terms of the common development and distribution licen[cs]e
cddl text when distributing covered (?:code|software) include this cddl header notice in each file
eupl notice licen[cs]ed under the eupl(?: version| v)? ?1 \d
eupl text this european union public licen[cs]e the eupl applies to the work
artistic text the intent of this document is to state the conditions under which a package may be copied
artistic text this licen[cs]e establishes the terms under which a given free software package may be copied modified distributed and or redistributed
artistic notice you can redistribute it and or modify it under the same terms as perl(?: itself)?
ruby notice you can redistribute it and or modify it under either the terms of the 2 clause bsdl
ruby notice (?:distributed|licen[cs]ed|available) under the same terms as ruby
python text psf is making python available to licen[cs]ee on an as is basis
python text this licen[cs]e agreement is between the python software foundation psf and the individual or organization
python text beopen is making the software available to licen[cs]ee on an as is basis
python text cwi grants permission to use copy modify and distribute this software
php text products derived from this software may not be called php
php text this product includes php software freely available from
openssl text this product includes software developed by the openssl project for use in the openssl toolkit
openssl text this product includes cryptographic software written by eric young
vim text there are no restrictions on distributing unmodified copies of vim except that they must include this licen[cs]e text
curl text permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
wtfpl text everyone is permitted to copy and distribute verbatim or modified copies of this licen[cs]e document and changing it is allowed as long as the name is changed
wtfpl text you just do what the fuck you want to
unlicense text this is free and unencumbered software released into the public domain
unlicense text anyone is free to copy modify publish use compile sell or distribute this software
unlicense text in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest
beerware text as long as you retain this notice you can do whatever you want with this stuff
beerware text if we meet some day and you think this stuff is worth it you can buy me a beer
ms-pl text this licen[cs]e governs use of the accompanying software if you use the software you accept this licen[cs]e
ms-rl text reciprocal grants for any file you distribute that contains code from the software
ofl notice this font software is licen[cs]ed under the sil open font licen[cs]e
ofl text the font software may be modified altered or added to
ofl text reserved font name refers to any names specified as such
odbl notice made available under the open database licen[cs]e
odbl text the odc open database licen[cs]e odbl is a licen[cs]e agreement intended to allow users to freely share modify and use this database
odc-by notice made available under the open data commons attribution licen[cs]e
pddl notice made available under the public domain dedication and licen[cs]e
cdla text the community data licen[cs]e agreement (?:permissive|sharing)
cc0 text the person who associated a work with this deed has dedicated the work to the public domain
cc0 text to the extent possible under law (?:[^ ]{1,40} ){1,12}waived all copyright and related or neighboring rights
cc0 text affirmer hereby overtly fully permanently irrevocably and unconditionally waives
cc-by-nc-sa notice licen[cs]ed under (?:a|the) creative commons attribution non ?commercial share ?alike
cc-by-nc-nd notice licen[cs]ed under (?:a|the) creative commons attribution non ?commercial no ?deriv(?:ative)?s
cc-by-nc notice licen[cs]ed under (?:a|the) creative commons attribution non ?commercial
cc-by-sa notice licen[cs]ed under (?:a|the) creative commons attribution share ?alike
cc-by-nd notice licen[cs]ed under (?:a|the) creative commons attribution no ?deriv(?:ative)?s
cc-by notice licen[cs]ed under (?:a|the) creative commons attribution
cc-by-sa notice text is available under the creative commons attribution share ?alike licen[cs]e
cc text by exercising the licen[cs]ed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons
bsl text the licen[cs]or hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licen[cs]ed work
bsl text change date (?:[^ ]{1,40} ){1,6}change licen[cs]e
sspl text if you make the functionality of the program or a modified version available to third parties as a service
elastic text you may not provide the software to third parties as a hosted or managed service
academic notice licen[cs]ed under the academic free licen[cs]e version \d \d
osl notice licen[cs]ed under the open software licen[cs]e version \d \d
upl text the universal permissive licen[cs]e upl version 1 0
blue-oak text each contributor licen[cs]es you to do everything with this software that would otherwise infringe that contributor s copyright
cecill text this licen[cs]e is a free software licen[cs]e agreement that is the result of discussions between its authors
cecill notice this software is governed by the cecill(?: [bc])? licen[cs]e under french law
mulan notice is licen[cs]ed under mulan psl v\d
polyform text the licen[cs]or grants you a copyright licen[cs]e for the software to do everything you might do with the software that would otherwise infringe
llama text llama (?:\d )?(?:\d )?community licen[cs]e agreement
openrail text open rail m licen[cs]e
unicode text permission is hereby granted free of charge to any person obtaining a copy of (?:the unicode )?data files and any associated documentation
w3c text permission to copy modify and distribute this work with or without modification for any purpose and without fee or royalty is hereby granted
fair text usage of the works is permitted provided that this instrument is retained with the works
ecl notice licen[cs]ed under the educational community licen[cs]e
proprietary text unauthorized copying of this file via any medium is strictly prohibited
proprietary text no part of this (?:[^ ]{1,40} ){1,6}may be reproduced
proprietary text this software is the confidential and proprietary information of
proprietary text proprietary and confidential
agpl notice under (?:the )?(?:terms of (?:the )?)?(?:gnu )?affero general public licen[cs]e(?: v(?:ersion)? ?\d)?(?: or (?:any )?later(?: version)?)?
lgpl notice under (?:the )?(?:terms of (?:the )?)?(?:gnu )?(?:lesser|library) general public licen[cs]e(?: v(?:ersion)? ?\d)?(?: or (?:any )?later(?: version)?)?
gpl notice under (?:the )?(?:terms of (?:the )?)?gnu general public licen[cs]e(?: v(?:ersion)? ?\d)?(?: or (?:any )?later(?: version)?)?
apache notice under (?:the )?(?:terms of (?:the )?)?apache (?:software )?licen[cs]e
mit notice under (?:the )?(?:terms of (?:the )?)?mit licen[cs]e
bsd notice under (?:the |a )?(?:terms of (?:the )?)?bsd licen[cs]e
mpl notice under (?:the )?(?:terms of (?:the )?)?mozilla public licen[cs]e
epl notice under (?:the )?(?:terms of (?:the )?)?eclipse public licen[cs]e
agpl link gnu org licen[cs]es agpl
lgpl link gnu org licen[cs]es (?:old licen[cs]es )?lgpl
gfdl link gnu org licen[cs]es (?:old licen[cs]es )?fdl
gpl link gnu org licen[cs]es (?:old licen[cs]es )?gpl
apache link apache org licen[cs]es
bsd-3-clause link opensource org licen[cs]es bsd 3 clause
bsd-2-clause link opensource org licen[cs]es bsd 2 clause
bsd link opensource org licen[cs]es bsd
mit link opensource org licen[cs]es mit
isc link opensource org licen[cs]es isc
artistic link opensource org licen[cs]es artistic
zlib link zlib net zlib licen[cs]e
mpl link mozilla org mpl
epl link eclipse org legal epl
edl link eclipse org org documents edl
cc0 link creativecommons org publicdomain zero
public-domain link creativecommons org publicdomain mark
cc-by-nc-sa link creativecommons org licen[cs]es by nc sa
cc-by-nc-nd link creativecommons org licen[cs]es by nc nd
cc-by-nc link creativecommons org licen[cs]es by nc
cc-by-sa link creativecommons org licen[cs]es by sa
cc-by-nd link creativecommons org licen[cs]es by nd
cc-by link creativecommons org licen[cs]es by
boost link boost org licen[cs]e
unlicense link unlicen[cs]e org
wtfpl link wtfpl net
ofl link scripts sil org ofl
odbl link opendatacommons org licen[cs]es odbl
odc-by link opendatacommons org licen[cs]es by
pddl link opendatacommons org licen[cs]es pddl
eupl link joinup ec europa eu (?:[^ ]{1,40} ){0,6}eupl
agpl name (?:gnu )?affero general public licen[cs]e(?: v(?:ersion)? ?\d)?
lgpl name (?:gnu )?(?:lesser|library) general public licen[cs]e(?: v(?:ersion)? ?\d)?
gpl name gnu general public licen[cs]e(?: v(?:ersion)? ?\d)?(?: or (?:any )?later(?: version)?)?
gpl name gnu gpl(?: v(?:ersion)? ?\d)?
gfdl name gnu free documentation licen[cs]e
apache name apache (?:software )?licen[cs]e(?: v(?:ersion)? ?\d(?: \d)?)?
mit name (?:the )?mit licen[cs]e
mit name x11 licen[cs]e
mit name expat licen[cs]e
bsd-2-clause name (?:2 clause|two clause|simplified|freebsd) bsd(?: licen[cs]e)?
bsd-2-clause name bsd (?:2|two) clause(?: licen[cs]e)?
bsd-3-clause name (?:3 clause|three clause|new|modified|revised) bsd(?: licen[cs]e)
bsd-3-clause name bsd (?:3|three) clause(?: licen[cs]e)?
bsd-4-clause name (?:4 clause|four clause|original) bsd(?: licen[cs]e)
bsd-4-clause name bsd (?:4|four) clause(?: licen[cs]e)?
bsd-0-clause name zero clause bsd(?: licen[cs]e)?
bsd name bsd(?: style)? licen[cs]e
isc name isc licen[cs]e
zlib name zlib(?: libpng)? licen[cs]e
mpl name mozilla public licen[cs]e(?: v(?:ersion)? ?\d(?: \d)?)?
epl name eclipse public licen[cs]e(?: v(?:ersion)? ?\d(?: \d)?)?
edl name eclipse distribution licen[cs]e
cddl name common development and distribution licen[cs]e
cpl name common public licen[cs]e
ibm-pl name ibm public licen[cs]e
eupl name european union public licen[cs]e
artistic name (?:clarified |perl )?artistic licen[cs]e
boost name boost software licen[cs]e
python name python software foundation licen[cs]e
python name psf licen[cs]e
php name php licen[cs]e
ruby name ruby licen[cs]e
openssl name openssl licen[cs]e
postgresql name postgresql licen[cs]e
curl name curl licen[cs]e
vim name vim licen[cs]e
wtfpl name do what the fuck you want to public licen[cs]e
wtfpl name wtfpl
unlicense name the unlicen[cs]e
ms-pl name microsoft public licen[cs]e
ms-rl name microsoft reciprocal licen[cs]e
ofl name (?:sil )?open font licen[cs]e
odbl name open (?:data commons )?(?:open )?database licen[cs]e
odc-by name open data commons attribution licen[cs]e
pddl name public domain dedication and licen[cs]e
cdla name community data licen[cs]e agreement
cc0 name creative commons (?:zero|cc0)
cc0 name cc0(?: 1 0)?
cc-by-nc-sa name creative commons attribution non ?commercial share ?alike
cc-by-nc-nd name creative commons attribution non ?commercial no ?deriv(?:ative)?s
cc-by-nc name creative commons attribution non ?commercial
cc-by-sa name creative commons attribution share ?alike
cc-by-nd name creative commons attribution no ?deriv(?:ative)?s
cc-by name creative commons attribution
cc-by-nc-sa name cc by nc sa(?: \d \d)?
cc-by-nc-nd name cc by nc nd(?: \d \d)?
cc-by-nc name cc by nc(?: \d \d)?
cc-by-sa name cc by sa(?: \d \d)?
cc-by-nd name cc by nd(?: \d \d)?
cc-by name cc by(?: \d \d)?
bsl name business source licen[cs]e
sspl name server side public licen[cs]e
elastic name elastic licen[cs]e(?: v(?:ersion)? ?\d)?
academic name academic free licen[cs]e
osl name open software licen[cs]e
ncsa name (?:university of illinois )?ncsa open source licen[cs]e
upl name universal permissive licen[cs]e
json name json licen[cs]e
beerware name beer ?ware licen[cs]e
blue-oak name blue oak model licen[cs]e
cecill name cecill(?: [bc])?(?: free software)? licen[cs]e
mulan name mulan permissive software licen[cs]e
polyform name polyform (?:noncommercial|small business|shield|strict|perimeter) licen[cs]e
openrail name (?:creativeml |bigscience )?open ?rail(?: m)? licen[cs]e
unicode name unicode licen[cs]e agreement
w3c name w3c software (?:notice and )?licen[cs]e
ecl name educational community licen[cs]e
etalab name etalab open licen[cs]e
ogl name open government licen[cs]e
gpl short gpl ?v?\d(?: \d)?(?: or later)?
lgpl short lgpl ?v?\d(?: \d)?(?: or later)?
agpl short agpl ?v?\d(?: \d)?(?: or later)?
mpl short mpl ?v?\d(?: \d)?
epl short epl ?v?\d(?: \d)?
cddl short cddl ?v?\d(?: \d)?
eupl short eupl ?v?\d(?: \d)?
apache short apache 2 0
public-domain reserved (?:in|into|to) the public domain
public-domain reserved public domain dedication
proprietary reserved all rights reserved
"""
