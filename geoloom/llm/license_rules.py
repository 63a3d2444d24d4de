"""Signature rules of licence texts and notices.

A rule is ``(label, priority, pattern)``, written by hand from the wording of
the licence, of the notice that its authors ask for, or of the ways in which
it is commonly named. Patterns match a text's words, lower case, with one blank
between words; their order decides between equals. Priorities: 90 whole
sentences of a licence, 80 notices, 70 addresses and identifiers, 60 names with
a version, 50 names without one, 30 general phrases.
"""

from __future__ import annotations

import re

#: Fixed base phrases: words that stand consecutively, and their labels.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

RULES = (
    # MIT and its kin
    ("mit", 90, r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", 80, r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", 70, r"spdx license identifier mit(?! 0)"),
    ("mit", 70, r"opensource org licenses? mit(?! 0)"),
    ("mit", 50, r"(?:released|licen[cs]ed|distributed|available|published) under (?:the )?(?:terms of the )?mit licen[cs]e"),
    ("mit", 50, r"(?:the )?mit licen[cs]e"),
    ("mit", 50, r"(?:the )?expat licen[cs]e"),
    ("mit", 50, r"licen[cs]e mit"),
    ("mit-0", 70, r"spdx license identifier mit 0"),
    ("mit-0", 60, r"mit no attribution(?: licen[cs]e)?"),
    ("x11", 70, r"spdx license identifier x11"),
    ("x11", 80, r"except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("x11", 50, r"x11 licen[cs]e"),
    ("isc", 90, r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", 70, r"spdx license identifier isc"),
    ("isc", 50, r"(?:the )?isc licen[cs]e"),
    ("0bsd", 90, r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("0bsd", 70, r"spdx license identifier 0bsd"),
    ("0bsd", 60, r"(?:zero|0) clause bsd(?: licen[cs]e)?"),
    ("ncsa", 80, r"university of illinois ncsa open source license"),
    ("ncsa", 70, r"spdx license identifier ncsa"),
    ("ncsa", 50, r"ncsa (?:open source )?licen[cs]e"),
    ("json", 80, r"the software shall be used for good not evil"),
    ("json", 70, r"spdx license identifier json"),
    ("curl", 70, r"spdx license identifier curl"),
    ("curl", 50, r"under the curl licen[cs]e"),
    # BSD
    ("bsd", 80, r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-3-clause", 90, r"neither the name of (?:\w+ ){1,12}nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-4-clause", 90, r"all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("bsd-2-clause-views", 80, r"the views and conclusions contained in the software and documentation are those of the authors"),
    ("bsd-2-clause", 70, r"spdx license identifier bsd 2 clause"),
    ("bsd-3-clause", 70, r"spdx license identifier bsd 3 clause"),
    ("bsd-4-clause", 70, r"spdx license identifier bsd 4 clause"),
    ("bsd-3-clause-clear", 75, r"spdx license identifier bsd 3 clause clear"),
    ("bsd-2-clause", 70, r"opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", 70, r"opensource org licenses bsd 3 clause"),
    ("bsd-2-clause", 60, r"(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)(?: style)? licen[cs]e"),
    ("bsd-3-clause", 60, r"(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)(?: style)? licen[cs]e"),
    ("bsd-4-clause", 60, r"(?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd|old bsd)(?: style)? licen[cs]e"),
    ("bsd", 50, r"(?:under (?:the |a )?)?bsd(?: style)? licen[cs]e"),
    ("bsd", 50, r"use of this source code is governed by a bsd style license"),
    # Apache
    ("apache-2", 90, r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2", 80, r"licensed under the apache license version 2(?: 0)?"),
    ("apache-2", 80, r"you may obtain a copy of the license at (?:https? )?(?:www )?apache org licenses license 2 0"),
    ("apache-2", 80, r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2", 75, r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2", 70, r"spdx license identifier apache 2(?: 0)?"),
    ("apache-2", 70, r"apache org licenses license 2 0"),
    ("apache-2", 60, r"apache (?:software )?licen[cs]e (?:v|v2|version 2|2)(?: 0)?"),
    ("apache-2", 60, r"apache (?:v ?)?2(?: 0)? licen[cs]e"),
    ("apache-2", 60, r"asl 2 0"),
    ("apache-1.1", 80, r"this product includes software developed by the apache software foundation"),
    ("apache-1.1", 70, r"spdx license identifier apache 1 1"),
    ("apache-1.1", 60, r"apache (?:software )?licen[cs]e version 1 1"),
    ("apache-1", 70, r"spdx license identifier apache 1 0"),
    ("apache-1", 60, r"apache (?:software )?licen[cs]e version 1 0"),
    ("apache", 50, r"(?:under )?(?:the )?(?:terms of the )?apache (?:software )?licen[cs]e"),
    # GNU GPL
    ("gpl-2", 90, r"under the terms of the gnu general public license as published by the free software foundation (?:either )?version 2"),
    ("gpl-3", 90, r"under the terms of the gnu general public license as published by the free software foundation (?:either )?version 3"),
    ("gpl", 80, r"under the terms of the gnu general public license"),
    ("gpl-2-or-later", 85, r"(?:either )?version 2 of the license or (?:at your option )?any later version"),
    ("gpl-3-or-later", 85, r"(?:either )?version 3 of the license or (?:at your option )?any later version"),
    ("gpl", 80, r"this program is free software you can redistribute it and or modify it under the terms"),
    ("gpl", 75, r"you should have received a copy of the gnu general public license along with this program"),
    ("gpl", 75, r"this program comes with absolutely no warranty this is free software and you are welcome to redistribute it"),
    ("gpl-2", 80, r"gnu general public license version 2 june 1991"),
    ("gpl-3", 80, r"gnu general public license version 3 29 june 2007"),
    ("gpl-1", 70, r"spdx license identifier gpl 1 0(?: only| or later)?"),
    ("gpl-2", 70, r"spdx license identifier gpl 2 0(?! or later)(?: only)?"),
    ("gpl-2-or-later", 75, r"spdx license identifier gpl 2 0 or later"),
    ("gpl-3", 70, r"spdx license identifier gpl 3 0(?! or later)(?: only)?"),
    ("gpl-3-or-later", 75, r"spdx license identifier gpl 3 0 or later"),
    ("gpl-2", 70, r"gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gpl-3", 70, r"gnu org licenses gpl 3 0"),
    ("gpl", 60, r"gnu org licenses gpl(?! [23])"),
    ("gpl-2", 60, r"(?:gnu )?(?:gpl|general public licen[cs]e) (?:2|v2|v 2|version 2)(?: 0)?"),
    ("gpl-3", 60, r"(?:gnu )?(?:gpl|general public licen[cs]e) (?:3|v3|v 3|version 3)(?: 0)?"),
    ("gpl-2", 60, r"(?:gplv2|gpl2)"),
    ("gpl-3", 60, r"(?:gplv3|gpl3)"),
    ("gpl", 50, r"gnu general public licen[cs]e"),
    ("gpl", 50, r"(?:licen[cs]ed|released|distributed) under (?:the )?(?:gnu )?gpl"),
    ("gpl-classpath-exception", 80, r"as a special exception the copyright holders of this library give you permission to link this library with independent modules"),
    ("gpl-classpath-exception", 75, r"gpl 2 0 (?:only |or later )?with classpath exception(?: 2 0)?"),
    ("gpl-gcc-exception", 80, r"gcc runtime library exception"),
    ("linux-syscall-note", 80, r"gpl 2 0 (?:only |or later )?with linux syscall note"),
    # GNU LGPL, AGPL, FDL
    ("lgpl-2.1", 90, r"under the terms of the gnu lesser general public license as published by the free software foundation (?:either )?version 2 1"),
    ("lgpl-2", 90, r"under the terms of the gnu library general public license as published by the free software foundation (?:either )?version 2"),
    ("lgpl-3", 90, r"under the terms of the gnu lesser general public license as published by the free software foundation (?:either )?version 3"),
    ("lgpl", 80, r"under the terms of the gnu (?:lesser|library) general public license"),
    ("lgpl", 75, r"you should have received a copy of the gnu (?:lesser|library) general public license along with this library"),
    ("lgpl-2.1", 80, r"gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-2", 70, r"spdx license identifier lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", 70, r"spdx license identifier lgpl 2 1(?: only| or later)?"),
    ("lgpl-3", 70, r"spdx license identifier lgpl 3 0(?: only| or later)?"),
    ("lgpl-2.1", 60, r"(?:gnu )?(?:lgpl|lesser general public licen[cs]e) (?:2|v2|v 2|version 2) 1"),
    ("lgpl-3", 60, r"(?:gnu )?(?:lgpl|lesser general public licen[cs]e) (?:3|v3|v 3|version 3)(?: 0)?"),
    ("lgpl-2.1", 60, r"lgplv2 1"),
    ("lgpl-3", 60, r"lgplv3"),
    ("lgpl", 50, r"gnu (?:lesser|library) general public licen[cs]e"),
    ("lgpl", 50, r"(?:licen[cs]ed|released|distributed) under (?:the )?(?:gnu )?lgpl"),
    ("agpl-3", 90, r"under the terms of the gnu affero general public license as published by the free software foundation (?:either )?version 3"),
    ("agpl", 75, r"you should have received a copy of the gnu affero general public license along with this program"),
    ("agpl-3", 70, r"spdx license identifier agpl 3 0(?: only| or later)?"),
    ("agpl-3", 70, r"gnu org licenses agpl 3 0"),
    ("agpl-3", 60, r"(?:gnu )?(?:agpl|affero general public licen[cs]e) (?:3|v3|v 3|version 3)(?: 0)?"),
    ("agpl-3", 60, r"agplv3"),
    ("agpl", 50, r"gnu affero general public licen[cs]e"),
    ("gfdl", 90, r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl-1.3", 70, r"spdx license identifier gfdl 1 3(?: only| or later)?"),
    ("gfdl-1.3", 60, r"gnu free documentation licen[cs]e version 1 3"),
    ("gfdl-1.2", 60, r"gnu free documentation licen[cs]e version 1 2"),
    ("gfdl", 50, r"gnu free documentation licen[cs]e"),
    # Mozilla, Eclipse, CDDL and other file-level copyleft
    ("mpl-2", 90, r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2", 80, r"if a copy of the mpl was not distributed with this file you can obtain one at (?:https? )?mozilla org mpl 2 0"),
    ("mpl-1.1", 90, r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2", 70, r"spdx license identifier mpl 2 0"),
    ("mpl-1.1", 70, r"spdx license identifier mpl 1 1"),
    ("mpl-2", 60, r"mozilla public licen[cs]e (?:v |v|version )?2(?: 0)?"),
    ("mpl-1.1", 60, r"mozilla public licen[cs]e (?:v |v|version )?1 1"),
    ("mpl", 50, r"mozilla public licen[cs]e"),
    ("epl-1", 90, r"this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("epl-2", 90, r"this program and the accompanying materials are made available under the terms of the eclipse public license (?:v|version )? ?2 0"),
    ("epl-1", 70, r"spdx license identifier epl 1 0"),
    ("epl-2", 70, r"spdx license identifier epl 2 0"),
    ("epl-1", 60, r"eclipse public licen[cs]e (?:v |v|version )?1(?: 0)?"),
    ("epl-2", 60, r"eclipse public licen[cs]e (?:v |v|version )?2(?: 0)?"),
    ("epl", 50, r"eclipse public licen[cs]e"),
    ("edl-1", 60, r"eclipse distribution licen[cs]e v(?:ersion)? ?1 0"),
    ("cddl-1", 90, r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("cddl-1", 70, r"spdx license identifier cddl 1 [01]"),
    ("cddl-1", 50, r"common development and distribution licen[cs]e"),
    ("cpl-1", 80, r"the accompanying program is provided under the terms of this common public license"),
    ("cpl-1", 70, r"spdx license identifier cpl 1 0"),
    ("cpl-1", 50, r"common public licen[cs]e(?: version 1 0)?"),
    ("ipl-1", 50, r"ibm public licen[cs]e(?: version 1 0)?"),
    ("osl-3", 70, r"spdx license identifier osl 3 0"),
    ("osl-3", 60, r"(?:licensed under the )?open software licen[cs]e (?:version |v )?3 0"),
    ("afl-3", 70, r"spdx license identifier afl 3 0"),
    ("afl-3", 60, r"(?:licensed under the )?academic free licen[cs]e (?:version |v )?3 0"),
    ("eupl-1.1", 80, r"licensed under the eupl version 1 1"),
    ("eupl-1.2", 80, r"licensed under the eupl version 1 2"),
    ("eupl-1.2", 70, r"spdx license identifier eupl 1 2"),
    ("eupl", 50, r"european union public licen[cs]e"),
    ("cecill-2.1", 70, r"spdx license identifier cecill 2 1"),
    ("cecill", 80, r"this software is governed by the cecill(?: \w)? license under french law"),
    ("cecill", 50, r"cecill(?: [bc])? licen[cs]e"),
    ("ms-pl", 70, r"spdx license identifier ms pl"),
    ("ms-pl", 60, r"microsoft public licen[cs]e"),
    ("ms-rl", 70, r"spdx license identifier ms rl"),
    ("ms-rl", 60, r"microsoft reciprocal licen[cs]e"),
    ("artistic-1", 80, r"under the same terms as perl itself"),
    ("artistic-2", 70, r"spdx license identifier artistic 2 0"),
    ("artistic-2", 60, r"artistic licen[cs]e (?:version |v )?2(?: 0)?"),
    ("artistic-1", 60, r"artistic licen[cs]e (?:version |v )?1(?: 0)?"),
    ("artistic", 50, r"(?:perl )?artistic licen[cs]e"),
    ("ruby", 70, r"spdx license identifier ruby"),
    ("ruby", 60, r"(?:under the|same terms as) ruby(?: s)? licen[cs]e"),
    ("python-2", 80, r"python software foundation license version 2"),
    ("python-2", 70, r"spdx license identifier (?:python|psf) 2 0"),
    ("python-2", 50, r"(?:python software foundation|psf) licen[cs]e"),
    ("php-3", 80, r"this source file is subject to version 3 0[01]? of the php license"),
    ("php-3", 70, r"spdx license identifier php 3 0[01]?"),
    ("php-3", 60, r"php licen[cs]e version 3 0[01]?"),
    ("postgresql", 90, r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("postgresql", 70, r"spdx license identifier postgresql"),
    ("postgresql", 60, r"(?:the )?postgresql licen[cs]e"),
    ("openssl", 90, r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("openssl", 70, r"spdx license identifier openssl"),
    ("openssl", 60, r"(?:the )?openssl licen[cs]e"),
    ("ssleay", 80, r"this product includes cryptographic software written by eric young"),
    ("zlib", 90, r"this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", 80, r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", 70, r"spdx license identifier zlib"),
    ("zlib", 60, r"(?:the )?zlib(?: libpng)? licen[cs]e"),
    ("libpng", 80, r"the png reference library is supplied as is"),
    ("libpng", 60, r"libpng licen[cs]e(?: version 2)?"),
    ("libtiff", 60, r"libtiff licen[cs]e"),
    ("ijg", 80, r"this software is based in part on the work of the independent jpeg group"),
    ("boost-1", 90, r"boost software license version 1 0 august 17th 2003"),
    ("boost-1", 80, r"distributed under the boost software license version 1 0"),
    ("boost-1", 70, r"spdx license identifier bsl 1 0"),
    ("boost-1", 70, r"boost org license 1 0"),
    ("boost-1", 50, r"boost software licen[cs]e"),
    ("w3c", 80, r"permission to copy modify and distribute this work with or without modification for any purpose and without fee or royalty is hereby granted"),
    ("w3c", 70, r"spdx license identifier w3c"),
    ("w3c", 60, r"w3c software (?:notice and )?licen[cs]e"),
    ("unicode", 60, r"unicode (?:inc )?licen[cs]e agreement(?: data files and software)?"),
    ("icu", 70, r"spdx license identifier (?:icu|unicode 3 0)"),
    ("vim", 60, r"under the vim licen[cs]e"),
    ("tcl", 60, r"tcl(?: tk)? licen[cs]e terms"),
    ("tcl", 70, r"spdx license identifier tcl"),
    ("upl-1", 70, r"spdx license identifier upl 1 0"),
    ("upl-1", 60, r"universal permissive licen[cs]e(?: \w+)? (?:v|version )? ?1 0"),
    ("ofl-1.1", 90, r"this font software is licensed under the sil open font license version 1 1"),
    ("ofl-1.1", 70, r"spdx license identifier ofl 1 1"),
    ("ofl-1.1", 60, r"(?:sil )?open font licen[cs]e(?: version 1 1)?"),
    ("bitstream-vera", 80, r"bitstream vera is a trademark of bitstream inc"),
    ("lppl-1.3c", 80, r"this work may be distributed and or modified under the conditions of the latex project public license"),
    ("lppl-1.3c", 70, r"spdx license identifier lppl 1 3c?"),
    ("beerware", 90, r"as long as you retain this notice you can do whatever you want with this stuff"),
    ("beerware", 60, r"(?:beer ware|beerware) licen[cs]e"),
    ("wtfpl", 80, r"do what the fuck you want to public licen[cs]e"),
    ("wtfpl", 60, r"wtfpl"),
    ("sleepycat", 60, r"sleepycat licen[cs]e"),
    ("blueoak-1", 70, r"spdx license identifier blueoak 1 0 0"),
    ("blueoak-1", 60, r"blue oak model licen[cs]e"),
    ("mulan-psl-2", 80, r"licensed under mulan psl v2"),
    ("mulan-psl-2", 60, r"mulan permissive software licen[cs]e"),
    # public domain
    ("unlicense", 90, r"this is free and unencumbered software released into the public domain"),
    ("unlicense", 70, r"spdx license identifier unlicense"),
    ("unlicense", 60, r"unlicense org"),
    ("unlicense", 50, r"under the unlicense"),
    ("cc0", 90, r"to the extent possible under law (?:\w+ ){1,12}has waived all copyright and related or neighboring rights"),
    ("cc0", 70, r"spdx license identifier cc0 1 0"),
    ("cc0", 70, r"creativecommons org publicdomain zero 1 0"),
    ("cc0", 60, r"cc0 1 0(?: universal)?"),
    ("cc0", 60, r"creative commons (?:zero|0)(?: 1 0)?(?: universal)?"),
    ("pddl-1", 60, r"public domain dedication and licen[cs]e"),
    ("public-domain", 50, r"(?:released|dedicated|placed|put) (?:in|into|to) the public domain"),
    ("public-domain", 30, r"is in the public domain"),
    # Creative Commons
    ("cc-by", 70, r"creativecommons org licenses by [1-4] [05]"),
    ("cc-by-sa", 70, r"creativecommons org licenses by sa [1-4] [05]"),
    ("cc-by-nd", 70, r"creativecommons org licenses by nd [1-4] [05]"),
    ("cc-by-nc", 70, r"creativecommons org licenses by nc [1-4] [05]"),
    ("cc-by-nc-sa", 70, r"creativecommons org licenses by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", 70, r"creativecommons org licenses by nc nd [1-4] [05]"),
    ("cc-by", 70, r"spdx license identifier cc by [1-4] [05]"),
    ("cc-by-sa", 70, r"spdx license identifier cc by sa [1-4] [05]"),
    ("cc-by-nc-sa", 70, r"spdx license identifier cc by nc sa [1-4] [05]"),
    ("cc-by", 60, r"creative commons attribution(?: [1-4](?: [05])?)?(?: international| unported)?(?! (?:share|non|no))"),
    ("cc-by-sa", 60, r"creative commons attribution share ?alike(?: [1-4](?: [05])?)?"),
    ("cc-by-nd", 60, r"creative commons attribution no ?deriv(?:s|atives|atives works)?(?: [1-4](?: [05])?)?"),
    ("cc-by-nc", 60, r"creative commons attribution non ?commercial(?: [1-4](?: [05])?)?(?! (?:share|no))"),
    ("cc-by-nc-sa", 60, r"creative commons attribution non ?commercial share ?alike(?: [1-4](?: [05])?)?"),
    ("cc-by-nc-nd", 60, r"creative commons attribution non ?commercial no ?deriv(?:s|atives)?(?: [1-4](?: [05])?)?"),
    ("cc-by", 60, r"cc by(?: [1-4](?: [05])?)(?: licen[cs]e)?"),
    ("cc-by", 50, r"cc by licen[cs]e"),
    ("cc-by-sa", 60, r"cc by sa(?: [1-4](?: [05])?)?(?: licen[cs]e)?"),
    ("cc-by-nd", 60, r"cc by nd(?: [1-4](?: [05])?)?(?: licen[cs]e)?"),
    ("cc-by-nc", 60, r"cc by nc(?! (?:sa|nd))(?: [1-4](?: [05])?)?(?: licen[cs]e)?"),
    ("cc-by-nc-sa", 60, r"cc by nc sa(?: [1-4](?: [05])?)?(?: licen[cs]e)?"),
    ("cc-by-nc-nd", 60, r"cc by nc nd(?: [1-4](?: [05])?)?(?: licen[cs]e)?"),
    ("cc", 50, r"(?:under a )?creative commons licen[cs]e"),
    # data
    ("odbl-1", 80, r"this (?:\w+ ){1,8}is made available under the open database license"),
    ("odbl-1", 70, r"spdx license identifier odbl 1 0"),
    ("odbl-1", 60, r"open (?:data commons open )?database licen[cs]e(?: v1 0| 1 0)?"),
    ("odc-by-1", 60, r"open data commons attribution licen[cs]e(?: v1 0| 1 0)?"),
    ("ogl-uk-3", 80, r"contains public sector information licensed under the open government licence v3 0"),
    ("ogl-uk-3", 60, r"open government licen[cs]e(?: v3 0| version 3 0)"),
    ("ogl", 50, r"open government licen[cs]e"),
    ("cdla-permissive-2", 60, r"community data license agreement permissive(?: version)? 2 0"),
    # source-available and commercial
    ("sspl-1", 70, r"spdx license identifier sspl 1 0"),
    ("sspl-1", 60, r"server side public licen[cs]e(?: v1| version 1)?"),
    ("busl-1.1", 70, r"spdx license identifier busl 1 1"),
    ("busl-1.1", 60, r"business source licen[cs]e(?: 1 1)?"),
    ("elastic-2", 80, r"licensed under the elastic license 2 0"),
    ("elastic-2", 60, r"elastic licen[cs]e (?:v ?2|2 0)"),
    ("polyform-noncommercial", 60, r"polyform noncommercial licen[cs]e"),
    ("commons-clause", 80, r"the license does not grant to you the right to sell the software"),
    ("commons-clause", 60, r"commons clause (?:licen[cs]e )?condition"),
    ("openrail", 60, r"(?:open rail|openrail|responsible ai) licen[cs]e"),
    ("proprietary", 60, r"(?:confidential and proprietary|proprietary and confidential)"),
    ("proprietary", 55, r"unauthorized (?:copying|reproduction|use|distribution) of this (?:file|software|material|document|publication)"),
    ("proprietary", 55, r"no part of this (?:publication|book|document|work) may be reproduced"),
    ("proprietary", 50, r"all rights reserved"),
    ("proprietary", 40, r"may not be (?:reproduced|redistributed|republished) without (?:the )?(?:prior |express )?(?:written )?(?:permission|consent)"),
    ("no-commercial", 40, r"(?:for )?(?:personal and )?non ?commercial (?:use|purposes) only"),
    ("no-commercial", 40, r"not for commercial (?:use|distribution|resale)"),
    ("evaluation", 40, r"for evaluation purposes only"),
    ("academic", 40, r"for (?:academic|educational|research) (?:use|purposes) only"),
    # general phrases
    ("warranty-disclaimer", 30, r"without warranties or conditions of any kind either express or implied"),
    ("warranty-disclaimer", 30, r"without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("warranty-disclaimer", 30, r"the software is provided as is without warranty of any kind"),
    ("warranty-disclaimer", 30, r"this software is provided by the copyright holders and contributors as is"),
    ("copyright", 20, r"copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d)?"),
    ("copyright", 20, r"(?:19|20)\d\d all rights reserved"),
)

#: What a match may lack without joining the words beside it: optional groups that begin or end with a blank, and looks ahead.
ABSENT = re.compile(r"\(\?:[^()]* \)\?|\(\?: [^()]*\)\?|\(\?![^()]*(?:\([^()]*\))?[^()]*\)")
#: A group that stands as whole words.
CHOICE = re.compile(r"(?<![^ ])\(\?:([^()]*)\)(?![^ ])")
#: A word without anything else that is part of a pattern.
PLAIN = re.compile(r"(?<![^ ])[a-z0-9]+(?![^ ])")


def longest(pattern: str) -> str | None:
    return max(PLAIN.findall(pattern), key=lambda w: (len(w), w), default=None)


def keywords(pattern: str) -> frozenset[str]:
    """Words of which every match of the pattern holds one: if possible a single word that it always holds."""
    bare = pattern
    while (less := ABSENT.sub("", bare)) != bare:
        bare = less
    outside = re.sub(r"\([^()]*\)(?:[?*+]|\{[^}]*\})?", "\x00", bare)
    if word := longest(outside):
        return frozenset([word])
    for m in CHOICE.finditer(bare):
        if all(found := [longest(x) for x in m[1].split("|")]):
            return frozenset(found)
    if "licen[cs]e" in outside.split():
        return frozenset(["license", "licence"])
    raise ValueError(f"no keyword: {pattern}")


def rules() -> list[tuple[str, int, str, frozenset[str]]]:
    """All rules in order: label, priority, pattern and keywords; the base phrases come first."""
    every = [(label, 100, phrase) for phrase, label in BASE] + list(RULES)
    return [(label, priority, pattern, keywords(pattern)) for label, priority, pattern in every]
