"""The license signatures: sentences of license texts, addresses, and families of names with the phrases around them.

All are regexes over lower-case words joined by one space. Each family of names gives a rule for each form below;
the order of the forms is their priority.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    """``keyword`` must stand in the text for the regex to be tried; ``priority`` 4 is the strongest."""

    name: str
    label: str
    priority: int
    confidence: float
    keyword: str
    pattern: str


V = r"(?: version)?(?: v)? ?"
#: label: (keyword, SPDX identifier as words, names from the most to the least exact).
FAMILIES: dict[str, tuple[str, str, tuple[str, ...]]] = {
    "mit": ("mit", r"mit", (r"mit license", r"mit licence", r"mit open source license", r"mit expat license")),
    "mit-0": ("mit", r"mit 0", (r"mit 0 license", r"mit no attribution license")),
    "apache-2": ("apache", r"apache 2 0", (r"apache license version 2(?: 0)?", r"apache license v?2(?: 0)?", r"apache software license(?: version)? 2(?: 0)?", r"apache 2(?: 0)? license")),
    "apache-1.1": ("apache", r"apache 1 1", (r"apache license version 1 1", r"apache software license(?: version)? 1 1", r"apache 1 1 license")),
    "apache": ("apache", r"apache", (r"apache license", r"apache software license", r"apache licence")),
    "gpl-3": ("general public", r"gpl 3 0(?: only| or later)?", (rf"(?:gnu )?general public license{V}3(?: 0)?", r"general public license either version 3")),
    "gpl-2": ("general public", r"gpl 2 0(?: only| or later)?", (rf"(?:gnu )?general public license{V}2(?: 0)?", r"general public license either version 2")),
    "gpl": ("general public", r"gpl", (r"gnu general public license", r"gnu general public licence", r"general public license as published by the free software foundation")),
    "gpl-3-short": ("gpl", r"gpl 3 0 plus", (r"gpl ?v3(?: 0)? license", r"gplv3 license", r"gnu gpl ?v?3(?: 0)?", r"license gpl ?v?3(?: 0)?")),
    "gpl-2-short": ("gpl", r"gpl 2 0 plus", (r"gpl ?v2(?: 0)? license", r"gplv2 license", r"gnu gpl ?v?2(?: 0)?", r"license gpl ?v?2(?: 0)?")),
    "lgpl-3": ("lesser", r"lgpl 3 0(?: only| or later)?", (rf"(?:gnu )?lesser general public license{V}3(?: 0)?",)),
    "lgpl-2.1": ("lesser", r"lgpl 2 1(?: only| or later)?", (rf"(?:gnu )?lesser general public license{V}2 1",)),
    "lgpl": ("lesser", r"lgpl", (r"gnu lesser general public license", r"lesser general public license", r"gnu lesser general public licence")),
    "lgpl-2": ("library general", r"lgpl 2 0(?: only| or later)?", (rf"(?:gnu )?library general public license(?:{V}2(?: 0)?)?",)),
    "agpl-3": ("affero", r"agpl 3 0(?: only| or later)?", (rf"(?:gnu )?affero general public license{V}3(?: 0)?",)),
    "agpl": ("affero", r"agpl", (r"gnu affero general public license", r"affero general public license")),
    "gfdl": ("documentation license", r"gfdl(?: 1 [123])?(?: only| or later)?", (rf"gnu free documentation license(?:{V}1 [123])?",)),
    "bsd-2": ("bsd", r"bsd 2 clause", (r"bsd 2 clause license", r"2 clause bsd license", r"simplified bsd license", r"two clause bsd license")),
    "bsd-3": ("bsd", r"bsd 3 clause", (r"bsd 3 clause license", r"3 clause bsd license", r"new bsd license", r"modified bsd license", r"revised bsd license")),
    "bsd-4": ("bsd", r"bsd 4 clause", (r"bsd 4 clause license", r"4 clause bsd license", r"original bsd license")),
    "bsd": ("bsd", r"bsd", (r"bsd license", r"bsd style license", r"bsd licence")),
    "0bsd": ("bsd", r"0bsd", (r"0bsd license", r"zero clause bsd license", r"bsd zero clause license")),
    "isc": ("isc", r"isc", (r"isc license", r"isc licence")),
    "mpl-2": ("mozilla", r"mpl 2 0", (rf"mozilla public license{V}2(?: 0)?", r"mozilla mpl 2 0 license")),
    "mpl-1.1": ("mozilla", r"mpl 1 1", (rf"mozilla public license{V}1 1",)),
    "mpl": ("mozilla", r"mpl", (r"mozilla public license",)),
    "epl-2": ("eclipse", r"epl 2 0", (rf"eclipse public license{V}2(?: 0)?",)),
    "epl-1": ("eclipse", r"epl 1 0", (rf"eclipse public license{V}1(?: 0)?", r"eclipse public license")),
    "eupl": ("european union", r"eupl 1 [12]", (rf"european union public licen[cs]e(?:{V}1 [12])?",)),
    "cddl": ("common development", r"cddl 1 [01]", (rf"common development and distribution license(?:{V}1 [01])?",)),
    "artistic-2": ("artistic", r"artistic 2 0", (rf"artistic license{V}2(?: 0)?", r"perl artistic license", r"artistic license")),
    "zlib": ("zlib", r"zlib", (r"zlib license", r"zlib libpng license")),
    "boost": ("boost", r"bsl 1 0", (rf"boost software license(?:{V}1 0)?",)),
    "unlicense": ("unlicense", r"unlicense", (r"the unlicense", r"unlicense license")),
    "wtfpl": ("fuck you want", r"wtfpl", (r"do what the fuck you want to public license",)),
    "python": ("python", r"psf 2 0|python 2 0", (r"python software foundation license(?: version 2)?", r"python psf license agreement")),
    "ofl": ("open font", r"ofl 1 [01]", (r"sil open font license(?: version 1 [01])?", r"open font license version 1 [01]", r"open font license")),
    "postgresql": ("postgresql", r"postgresql", (r"postgresql license", r"postgresql licence")),
    "php": ("php", r"php 3 01?", (r"php license(?: version 3 01?)?",)),
    "ruby": ("ruby", r"ruby", (r"ruby license",)),
    "ncsa": ("ncsa", r"ncsa", (r"university of illinois ncsa open source license", r"ncsa open source license")),
    "w3c": ("w3c", r"w3c", (r"w3c software notice and license", r"w3c software and document license")),
    "odbl": ("open database", r"odbl 1 0", (r"open database license(?: v?1 0)?",)),
    "odc-by": ("commons attribution", r"odc by 1 0", (r"open data commons attribution license(?: v?1 0)?",)),
    "pddl": ("domain dedication", r"pddl 1 0", (r"public domain dedication and license(?: v?1 0)?",)),
    "ogl-uk": ("open government", r"ogl uk [123] 0", (r"open government licence(?: v?[123](?: 0)?)?",)),
    "cc0": ("cc0", r"cc0 1 0", (r"cc0 1 0(?: universal)?(?: public domain dedication)?", r"cc0 license", r"creative commons cc0"),),
    "cc-by": ("cc by", r"cc by [1234] \d", (r"cc by(?: license)?(?: [1234] \d)?(?! (?:nc|sa|nd))",)),
    "cc-by-sa": ("cc by", r"cc by sa [1234] \d", (r"cc by sa(?: license)?(?: [1234] \d)?",)),
    "cc-by-nd": ("cc by", r"cc by nd [1234] \d", (r"cc by nd(?: license)?(?: [1234] \d)?",)),
    "cc-by-nc": ("cc by", r"cc by nc [1234] \d", (r"cc by nc(?: license)?(?: [1234] \d)?(?! (?:sa|nd))",)),
    "cc-by-nc-sa": ("cc by", r"cc by nc sa [1234] \d", (r"cc by nc sa(?: license)?(?: [1234] \d)?",)),
    "cc-by-nc-nd": ("cc by", r"cc by nc nd [1234] \d", (r"cc by nc nd(?: license)?(?: [1234] \d)?",)),
    "cc-by-long": ("creative commons", r"cc by", (r"creative commons attribution(?: (?:[1234] \d )?(?:international|unported|generic))?(?: public)? license", r"creative commons attribution [1234] \d")),
    "cc-by-sa-long": ("creative commons", r"cc by sa", (r"creative commons attribution share ?alike(?: [1234] \d)?(?: international| unported| generic)?(?: public)?(?: license)?",)),
    "cc-by-nc-long": ("creative commons", r"cc by nc", (r"creative commons attribution non ?commercial(?: [1234] \d)?(?: international| unported| generic)?(?: public)?(?: license)?(?! (?:share|no))",)),
    "cc-by-nd-long": ("creative commons", r"cc by nd", (r"creative commons attribution no ?deriv(?:ative)?s(?: works)?(?: [1234] \d)?(?: license)?",)),
    "cc-by-nc-sa-long": ("creative commons", r"cc by nc sa", (r"creative commons attribution non ?commercial share ?alike(?: [1234] \d)?(?: license)?",)),
    "public-domain": ("public domain", r"public domain", (r"(?:released|dedicated|placed) (?:in)?to the public domain", r"dedicate[sd]? (?:any and all )?copyright interest in (?:this|the) (?:software|work) to the public domain")),
    "proprietary": ("all rights reserved", r"proprietary", (r"copyright (?:c )?(?:\d{4} )(?:\S+ ){0,8}all rights reserved",)),
}
#: Families that only differ in how the license is written share a label.
SAME = {"gpl-3-short": "gpl-3", "gpl-2-short": "gpl-2", "cc-by-long": "cc-by", "cc-by-sa-long": "cc-by-sa", "cc-by-nc-long": "cc-by-nc", "cc-by-nd-long": "cc-by-nd", "cc-by-nc-sa-long": "cc-by-nc-sa"}
#: Sentences of license texts and notices, as words: (label, keyword, regex).
TEXTS: tuple[tuple[str, str, str], ...] = (
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "sublicense and or sell", r"rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "permission notice shall be included", r"(?:the )?above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-modern", "permission is hereby granted", r"permission is hereby granted without written agreement and without license or royalty fees to use copy modify and distribute this software"),
    ("x11", "in advertising or otherwise", r"except as contained in this notice the names? of (?:\S+ ){1,12}shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization"),
    ("json", "used for good not evil", r"(?:permission notice shall be included in all copies or substantial portions of the software )?the software shall be used for good not evil"),
    ("isc", "permission to use", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "permission to use", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("hpnd", "permission to use", r"permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted"),
    ("postgresql", "without a written agreement", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("ntp", "permission to use", r"permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted"),
    ("curl", "permission to use", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions of source code", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation"),
    ("bsd-3", "endorse or promote products", r"neither the names? of (?:\S+ ){1,16}nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior (?:written )?permission"),
    ("bsd-4", "advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-3-clear", "patent rights", r"no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-patent", "patent license", r"each copyright holder and contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:except for failure to satisfy the conditions of this license )?patent license"),
    ("apache-2", "compliance with the license", r"you may not use this file except in compliance with the license"),
    ("apache-2", "distributed on an as is basis", r"software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("apache-2", "terms and conditions of this license", r"subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("apache-1.1", "software developed by the apache", r"end user documentation included with the redistribution if any must include the following acknowledg(?:e)?ment this product includes software developed by the apache software foundation|redistribution acknowledgment this product includes software developed by the apache software foundation"),
    ("gpl", "free software", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "general public license", r"you should have received a copy of the gnu general public license along with"),
    ("gpl", "warranty of merchantability", r"this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability"),
    ("gpl", "verbatim copies of this license", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gpl-2", "general public license", r"gnu general public license as published by the free software foundation (?:either )?version 2"),
    ("gpl-3", "general public license", r"gnu general public license as published by the free software foundation (?:either )?version 3"),
    ("gpl-2", "general public license", r"the gnu general public license is intended to guarantee your freedom to share and change free software"),
    ("gpl-3", "general public license", r"the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-classpath", "linking this library", r"linking this library statically or dynamically with other modules is making a combined work based on this library (?:thus the terms and conditions of the gnu general public license)?"),
    ("lgpl", "free software", r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("lgpl", "lesser general public license", r"you should have received a copy of the gnu lesser general public license along with"),
    ("lgpl-2.1", "lesser general public license", r"gnu lesser general public license as published by the free software foundation (?:either )?version 2 1"),
    ("lgpl-3", "lesser general public license", r"gnu lesser general public license as published by the free software foundation (?:either )?version 3"),
    ("lgpl-2.1", "derivative work of the library", r"such a work in isolation is not a derivative work of the library and therefore falls outside the scope of this license"),
    ("agpl-3", "affero general public license", r"gnu affero general public license as published by the free software foundation (?:either )?version 3"),
    ("agpl-3", "affero general public license", r"you should have received a copy of the gnu affero general public license along with"),
    ("agpl-3", "affero general public license", r"the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community"),
    ("gfdl", "free documentation license", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-2", "mozilla public license", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", "mozilla public license", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl", "incompatible with secondary licenses", r"this source code form is incompatible with secondary licenses as defined by the mozilla public license"),
    ("epl-1", "eclipse public license", r"the accompanying program is provided under the terms of this eclipse public license"),
    ("epl-2", "eclipse public license", r"this program and the accompanying materials are made available under the terms of the eclipse public license (?:v )?2 0"),
    ("cpl", "common public license", r"the accompanying program is provided under the terms of this common public license"),
    ("ibm-pl", "ibm public license", r"the accompanying program is provided under the terms of this ibm public license"),
    ("cddl", "common development", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("eupl", "eupl", r"licensed under the eupl|this european union public licence the eupl applies to the work"),
    ("osl-3", "open software license", r"licensed under the open software license version 3 0"),
    ("afl-3", "academic free license", r"licensed under the academic free license version 3 0"),
    ("artistic-1", "semblance of artistic control", r"the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control"),
    ("artistic-2", "free software package", r"this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("perl", "same terms as perl", r"(?:this (?:program|library|module) is free software )?you can redistribute it and or modify it under the same terms as perl itself"),
    ("zlib", "as is", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", "freely subject to the following restrictions", r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("libpng", "portions hereof", r"permission is hereby granted to use copy modify and distribute this source code or portions hereof for any purpose without fee"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "copyright", r"we make this dedication for the benefit of the public at large and to the detriment of our heirs (?:and successors )?we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law|dedicate any and all copyright interest in the software to the public domain"),
    ("boost", "permission is hereby granted", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("wtfpl", "what the fuck you want", r"do what the fuck you want to public license terms and conditions for copying distribution and modification"),
    ("beerware", "beer ware", r"the beer ware license(?: revision 42)?"),
    ("python", "python software foundation", r"this license agreement is between the python software foundation psf and the individual or organization"),
    ("python", "psf hereby grants", r"subject to the terms and conditions of this license agreement psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("php", "php license", r"this source file is subject to version 3 01? of the php license"),
    ("php", "products derived from this software", r"products derived from this software may not be called php nor may php appear in their name without prior written permission from group php net"),
    ("openssl", "openssl toolkit", r"this product includes software developed by the openssl project for use in the openssl toolkit (?:http www openssl org )?(?:redistributions of any form whatsoever must retain the following acknowledgment)"),
    ("ofl", "open font license", r"this font software is licensed under the sil open font license"),
    ("ofl", "font software", r"the font software including any derivative works can be bundled embedded redistributed and or sold with any software provided that any reserved names? are not used by derivative works"),
    ("freetype", "freetype", r"portions of this software are copyright (?:\d{4} )?the freetype project|under the terms of the freetype license"),
    ("ijg", "thomas g lane", r"copyright c 1991 \d{4} thomas g lane"),
    ("ncsa", "deal with the software", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction"),
    ("w3c", "w3c", r"permission to (?:use )?copy modify and distribute this (?:work|software and its documentation) with or without modification for any purpose and without fee or royalty is hereby granted provided that you include the following (?:on all copies )?w3c"),
    ("lppl", "latex project public license", r"this work may be distributed and or modified under the conditions of the latex project public license"),
    ("vim", "vim license", r"you must distribute your changes under the (?:gnu gpl or the )?vim license|under the vim license"),
    ("ms-pl", "microsoft public license", r"licensed under the microsoft public license"),
    ("ms-pl", "accompanying software", r"this license governs use of the accompanying software if you use the software you accept this license"),
    ("ms-rl", "microsoft reciprocal license", r"licensed under the microsoft reciprocal license"),
    ("upl", "universal permissive license", r"the universal permissive license upl version 1 0"),
    ("mulan", "mulan psl", r"licensed under mulan psl v[12]"),
    ("blue-oak", "blue oak", r"blue oak model license version 1 0 0"),
    ("cecill", "cecill", r"this software is governed by the cecill(?: [bc])? license under french law"),
    ("ecl-2", "educational community license", r"licensed under the educational community license version 2 0"),
    ("zope", "zope public license", r"zope public license zpl version 2 [01]"),
    ("sleepycat", "sleepycat license", r"the sleepycat license|sleepycat license redistributions in any form must be accompanied by information on how to obtain complete source code"),
    ("icu", "icu license", r"icu license icu 1 8 1 and later copyright"),
    ("unicode", "unicode", r"unicode license v3|unicode inc license agreement data files and software"),
    ("cc0", "has waived all copyright", r"to the extent possible under law (?:\S+ ){1,12}has waived all copyright and related or neighboring rights to"),
    ("cc0", "waives abandons and surrenders", r"affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders all of affirmer s copyright and related rights"),
    ("cc", "creative commons public license", r"the work as defined below is provided under the terms of this creative commons public license ccpl or license"),
    ("cc", "creative commons", r"by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons"),
    ("cc-by", "creative commons", r"this work is licensed under a creative commons attribution(?: \d \d)?(?: international| unported)? license"),
    ("cc-by-sa", "creative commons", r"this work is licensed under a creative commons attribution share ?alike(?: \d \d)?(?: international| unported)? license"),
    ("cc-by-nc", "creative commons", r"this work is licensed under a creative commons attribution non ?commercial(?: \d \d)?(?: international| unported)? license"),
    ("cc-by-nd", "creative commons", r"this work is licensed under a creative commons attribution no ?deriv(?:ative)?s(?: \d \d)?(?: international| unported)? license"),
    ("cc-by-nc-sa", "creative commons", r"this work is licensed under a creative commons attribution non ?commercial share ?alike(?: \d \d)?(?: international| unported)? license"),
    ("cc-by-nc-nd", "creative commons", r"this work is licensed under a creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: \d \d)?(?: international| unported)? license"),
    ("cc-by-sa", "text is available under", r"text is available under the creative commons attribution share ?alike license"),
    ("odbl", "open database license", r"this (?:\S+ ){0,6}is made available under the open database license"),
    ("odc-by", "open data commons", r"this (?:\S+ ){0,6}is made available under the open data commons attribution license"),
    ("pddl", "public domain dedication", r"this (?:\S+ ){0,6}is made available under the public domain dedication and license"),
    ("ogl-uk", "open government licence", r"contains public sector information licensed under the open government licence"),
    ("elastic-2", "elastic license", r"licensed under the elastic license(?: 2 0)?|elastic license 2 0"),
    ("sspl", "server side public license", r"server side public license(?: version 1| v 1)?"),
    ("busl", "business source license", r"business source license(?: 1 1)?|use of this software is governed by the business source license"),
    ("commons-clause", "commons clause", r"commons clause license condition v1 0"),
    ("commons-clause", "provided to you by the licensor", r"the software is provided to you by the licensor under the license as defined below subject to the following condition"),
    ("polyform", "polyform", r"polyform (?:noncommercial|shield|small business|strict|perimeter|free trial|internal use) license 1 0 \d"),
    ("openrail", "rail", r"(?:creativeml )?open ?rail (?:m )?license|bigscience (?:bloom )?rail license v1 0|responsible ai license rail"),
    ("cc-devnations", "developing nations", r"creative commons developing nations license"),
    ("proprietary", "confidential and proprietary", r"this software is the confidential and proprietary information of (?:\S+ ){1,10}and (?:may|shall) not be disclosed (?:\S+ ){0,8}license agreement"),
    ("proprietary", "unauthorized copying", r"unauthorized copying of this (?:file|software|material) via any medium is strictly prohibited (?:\S+ ){0,6}copyright"),
    ("proprietary", "may be reproduced", r"no part of this (?:publication|book|work|document) may be reproduced (?:\S+ ){1,24}(?:copyright|prior written permission of the (?:publisher s license|copyright holder))"),
)
#: Web addresses of license texts, as words.
ADDRESSES: tuple[tuple[str, str, str], ...] = (
    ("apache-2", "apache org", r"apache org licenses license 2 0"),
    ("mit", "opensource org", r"opensource org licen[cs]es?(?: php)? mit(?: license)?"),
    ("bsd-3", "opensource org", r"opensource org licen[cs]es?(?: php)? bsd 3 clause"),
    ("bsd-2", "opensource org", r"opensource org licen[cs]es?(?: php)? bsd 2 clause"),
    ("isc", "opensource org", r"opensource org licen[cs]es?(?: php)? isc"),
    ("gpl", "gnu org", r"gnu org (?:copyleft|licenses) gpl(?: [23] 0)?"),
    ("lgpl", "gnu org", r"gnu org (?:copyleft lesser|licenses lgpl)(?: [23] [01])?"),
    ("agpl", "gnu org", r"gnu org licenses agpl(?: 3 0)?"),
    ("mpl-2", "mozilla org", r"mozilla org mpl 2 0"),
    ("cc0", "creativecommons org", r"creativecommons org publicdomain zero 1 0"),
    ("cc-by", "creativecommons org", r"creativecommons org licenses by [1234] \d"),
    ("cc-by-sa", "creativecommons org", r"creativecommons org licenses by sa [1234] \d"),
    ("cc-by-nc", "creativecommons org", r"creativecommons org licenses by nc [1234] \d"),
    ("cc-by-nd", "creativecommons org", r"creativecommons org licenses by nd [1234] \d"),
    ("cc-by-nc-sa", "creativecommons org", r"creativecommons org licenses by nc sa [1234] \d"),
    ("cc-by-nc-nd", "creativecommons org", r"creativecommons org licenses by nc nd [1234] \d"),
)
GRANT = r"(?:dual )?(?:licen[cs]ed|released|distributed|published|(?:made )?available|provided|covered|redistributed) (?:(?:only|also) )?under (?:the )?(?:(?:terms|conditions)(?: and conditions)? of )?(?:the )?(?:an? )?"
FIELD = r"(?:license|licence|licensing|copyright)s?(?: is| are| type| name)? (?:under )?(?:the )?"
#: One of these stands in each text that a rule can match, whichever of its alternatives; the cheap test that most documents end with.
ANCHORS = (
    "licen", "copyright", "spdx", "cc by", "cc0", "gpl", "copyleft", "creative commons", "creativecommons", "public domain", "permission is hereby", "permission to", "permission is granted", "redistribut", "provided as is",
    "opensource org", "mozilla org mpl", "warranty of merchantability", "as is basis", "advertising materials", "prior permission", "prior written", "used for good not evil", "eupl", "open rail", "openrail", "sell copies of the software",
    "the same terms as perl", "combined work based on this library", "mulan psl", "zope public",
)


def rules() -> list[Rule]:
    out = [Rule(f"text-{i}", label, 4, 1.0, key, pattern) for i, (label, key, pattern) in enumerate(TEXTS)]
    out += [Rule(f"address-{label}-{i}", label, 3, 0.95, key, pattern) for i, (label, key, pattern) in enumerate(ADDRESSES)]
    for family, (key, spdx, names) in FAMILIES.items():
        label = SAME.get(family, family)
        out.append(Rule(f"spdx-{family}", label, 4, 1.0, "spdx", rf"spdx license identifier (?:{spdx})(?! (?:\d|only|or later|nc|sa|nd|clause))"))
        for i, name in enumerate(names):
            # The more exact of two names of a family or of its unversioned kin contains the other.
            out += [
                Rule(f"grant-{family}-{i}", label, 3, 0.98, key, GRANT + f"(?:{name})"),
                Rule(f"field-{family}-{i}", label, 2, 0.9, key, FIELD + f"(?:{name})"),
                Rule(f"name-{family}-{i}", label, 2, 0.8, key, f"(?:{name})"),
            ]
    return out
