"""The signatures of the license scan, each written by hand from the public texts, notices, deeds and names of licenses.

Patterns read a text's words: ASCII lower case, one space between, no punctuation, so ``GPL-2.0`` is ``gpl 2 0``.
A rule has a label, a keyword that each of its matches holds, and a pattern.  In a tier, rules come in order of priority.
"""

#: Tiers by strength: an identifier, a passage of a license's text, a notice that grants it, a name with version, a name alone.
TAG, TEXT, NOTICE, VERSIONED, NAME = range(5)
#: What a match of each tier is worth.
CONFIDENCE = (1.0, 0.98, 0.95, 0.85, 0.7)
#: Every keyword holds one of these, so a text without any of them has no match.
STEMS = (
    "licen", "permission", "redistribut", "warrant", "copyright", "public domain", "creative commons", "creativecommons", "gnu ", "gpl", "apache", "mozilla",
    "mpl ", "spdx", "cc by", "cc0", "cc zero", "wtfpl", "the software", "this software", "bsd", "proprietary", "unauthorized copying", "combined work", "the origin of", "altered source",
    "eupl", "cecill", "anyone is free", "modified material", "includes software", "zlib", "w3c", "written agreement", "beer ware", "this notice", "intellectual property",
)

#: Operands of an expression after ``SPDX-License-Identifier:``.
TAGS = (
    ("mit-0", "mit 0"),
    ("mit", "mit"),
    ("apache-1.0", "apache 1 0"),
    ("apache-1.1", "apache 1 1"),
    ("apache-2.0", "apache 2 0"),
    ("bsd-2-clause-patent", "bsd 2 clause patent"),
    ("bsd-2-clause-views", "bsd 2 clause views"),
    ("bsd-2-clause", "bsd 2 clause"),
    ("bsd-3-clause-clear", "bsd 3 clause clear"),
    ("bsd-3-clause", "bsd 3 clause"),
    ("bsd-4-clause", "bsd 4 clause"),
    ("0bsd", "0bsd"),
    ("isc", "isc"),
    ("zlib", "zlib"),
    ("bsl-1.0", "bsl 1 0"),
    ("gpl-1.0-or-later", "gpl 1 0 or later"),
    ("gpl-2.0-only", "gpl 2 0 only"),
    ("gpl-2.0-or-later", "gpl 2 0 or later"),
    ("gpl-2.0", "gpl 2 0"),
    ("gpl-3.0-only", "gpl 3 0 only"),
    ("gpl-3.0-or-later", "gpl 3 0 or later"),
    ("gpl-3.0", "gpl 3 0"),
    ("lgpl-2.0-only", "lgpl 2 0 only"),
    ("lgpl-2.0-or-later", "lgpl 2 0 or later"),
    ("lgpl-2.1-only", "lgpl 2 1 only"),
    ("lgpl-2.1-or-later", "lgpl 2 1 or later"),
    ("lgpl-2.1", "lgpl 2 1"),
    ("lgpl-3.0-only", "lgpl 3 0 only"),
    ("lgpl-3.0-or-later", "lgpl 3 0 or later"),
    ("lgpl-3.0", "lgpl 3 0"),
    ("agpl-3.0-only", "agpl 3 0 only"),
    ("agpl-3.0-or-later", "agpl 3 0 or later"),
    ("agpl-3.0", "agpl 3 0"),
    ("gfdl-1.2", "gfdl 1 2(?: only| or later)?"),
    ("gfdl-1.3", "gfdl 1 3(?: only| or later)?"),
    ("mpl-1.1", "mpl 1 1"),
    ("mpl-2.0", "mpl 2 0(?: no copyleft exception)?"),
    ("epl-1.0", "epl 1 0"),
    ("epl-2.0", "epl 2 0"),
    ("cddl-1.0", "cddl 1 0"),
    ("cddl-1.1", "cddl 1 1"),
    ("eupl-1.1", "eupl 1 1"),
    ("eupl-1.2", "eupl 1 2"),
    ("cc0-1.0", "cc0 1 0"),
    ("cc-by-3.0", "cc by 3 0"),
    ("cc-by-4.0", "cc by 4 0"),
    ("cc-by-sa-3.0", "cc by sa 3 0"),
    ("cc-by-sa-4.0", "cc by sa 4 0"),
    ("cc-by-nc-4.0", "cc by nc 4 0"),
    ("cc-by-nd-4.0", "cc by nd 4 0"),
    ("cc-by-nc-sa-4.0", "cc by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", "cc by nc nd 4 0"),
    ("unlicense", "unlicense"),
    ("wtfpl", "wtfpl"),
    ("artistic-1.0", "artistic 1 0"),
    ("artistic-2.0", "artistic 2 0"),
    ("ofl-1.1", "ofl 1 1"),
    ("psf-2.0", "(?:psf|python) 2 0"),
    ("postgresql", "postgresql"),
    ("ncsa", "ncsa"),
    ("ms-pl", "ms pl"),
    ("ms-rl", "ms rl"),
    ("upl-1.0", "upl 1 0"),
    ("ecl-2.0", "ecl 2 0"),
    ("afl-3.0", "afl 3 0"),
    ("osl-3.0", "osl 3 0"),
    ("odbl-1.0", "odbl 1 0"),
    ("pddl-1.0", "pddl 1 0"),
    ("busl-1.1", "busl 1 1"),
    ("sspl-1.0", "sspl 1 0"),
    ("elastic-2.0", "elastic 2 0"),
    ("x11", "x11"),
    ("curl", "curl"),
    ("openssl", "openssl"),
    ("blueoak-1.0.0", "blueoak 1 0 0"),
    ("hpnd", "hpnd"),
    ("classpath-exception-2.0", "classpath exception 2 0"),
    ("llvm-exception", "llvm exception"),
)

#: Passages of license texts and of the headers that licenses ask for.
TEXTS = (
    # MIT and its kin
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of (?:this|the) software and associated documentation files"),
    ("mit", "copies of the software", "without (?:restriction|limitation) (?:including )?(?:without limitation )?(?:on )?the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "this permission notice shall be included", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-modern", "this permission notice including the next paragraph", "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software"),
    ("x11", "except as contained in this notice", "except as contained in this notice the names? of (?:[^ ]+ ){1,14}?shall not be used in advertising or otherwise to promote the sale use or other dealings in this software"),
    ("bsl-1.0", "any person or organization obtaining a copy of the software", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("ncsa", "to deal with the software without restriction", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction"),
    # ISC, HPND and others that begin with a permission
    ("isc", "this permission notice appear in all copies", "permission to use copy modify (?:and or|and) distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("0bsd", "for any purpose with or without fee is hereby granted the software", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("hpnd", "this software and its documentation for any purpose", "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("hpnd-sell", "sell this software and its documentation", "permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee"),
    ("postgresql", "without a written agreement is hereby granted", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("curl", "permission to use copy modify and distribute this software for any purpose", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies except as contained in this notice"),
    ("fsfap", "without royalty provided the copyright notice and this notice", "copying and distribution of this file with or without modification are permitted in any medium without royalty provided the copyright notice and this notice are preserved"),
    # BSD
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-3-clause", "derived from this software without specific prior", "neither the names? of (?:[^ ]+ ){1,14}?nor the names of (?:its|their|the) contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-3-clause", "may not be used to endorse or promote products derived from this software", "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-3-clause-clear", "no express or implied licenses to any party s patent rights", "no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-4-clause", "mentioning features or use of this software must display", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-2-clause-views", "views and conclusions contained in the software", "the views and conclusions contained in the software and documentation are those of the authors and should not be interpreted as representing official policies"),
    ("bsd-2-clause-patent", "hereby grants to those receiving rights under this license", "each copyright holder and contributor hereby grants to those receiving rights under this license a perpetual worldwide"),
    ("bsd", "this software is provided by the copyright holders and contributors as is", "this software is provided by the copyright holders and contributors as is and any express or implied warranties"),
    # zlib
    ("zlib", "this software is provided as is without any express or implied warranty", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "the origin of this software must not be misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "altered source versions must be plainly marked", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    # Apache
    ("apache-2.0", "the license you may not use this file except", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2.0", "software distributed under the license is distributed on an as is basis", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", "apache org licenses license 2 0", "(?:www )?apache org licenses license 2 0(?: txt| html)?"),
    ("apache-2.0", "under one or more contributor license agreements", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2.0", "apache license version 2 0 january 2004", "apache license version 2 0 january 2004"),
    ("apache-2.0", "grant of copyright license subject to the terms", "grant of copyright license subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("apache-1.1", "developed by the apache software foundation", "this product includes software developed by the apache software foundation"),
    ("apache-1.0", "developed by the apache group", "this product includes software developed by the apache group for use in the apache http server project"),
    # GNU
    ("gpl-2.0", "gnu general public license version 2 june 1991", "gnu general public license version 2 june 1991"),
    ("gpl-3.0", "gnu general public license version 3 29 june 2007", "gnu general public license version 3 29 june 2007"),
    ("gpl-1.0", "gnu general public license version 1 february 1989", "gnu general public license version 1 february 1989"),
    ("lgpl-2.0", "gnu library general public license version 2 june 1991", "gnu library general public license version 2 june 1991"),
    ("lgpl-2.1", "gnu lesser general public license version 2 1 february 1999", "gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-3.0", "gnu lesser general public license version 3 29 june 2007", "gnu lesser general public license version 3 29 june 2007"),
    ("agpl-3.0", "gnu affero general public license version 3 19 november 2007", "gnu affero general public license version 3 19 november 2007"),
    ("gpl", "the licenses for most software are designed to take away your freedom", "the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl", "the gnu general public license is a free copyleft license", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl", "without even the implied warranty of merchantability", "in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license"),
    ("lgpl", "without even the implied warranty of merchantability", "in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu (?:lesser|library) general public license"),
    ("agpl", "without even the implied warranty of merchantability", "in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu affero general public license"),
    ("classpath-exception-2.0", "is making a combined work based on", "linking this library statically or dynamically with other modules is making a combined work based on this library"),
    # Mozilla, Eclipse, Sun
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "if a copy of the mpl was not distributed with this file", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-2.0-no-copyleft-exception", "incompatible with secondary licenses", "this source code form is incompatible with secondary licenses as defined by the mozilla public license"),
    ("mpl-1.1", "subject to the mozilla public license version 1 1", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-1.0", "subject to the mozilla public license version 1 0", "the contents of this file are subject to the mozilla public license version 1 0"),
    ("mpl", "software distributed under the license is distributed on an as is basis without warranty", "software distributed under the license is distributed on an as is basis without warranty of any kind either express or implied see the license for the specific language governing rights and limitations"),
    ("epl-1.0", "terms of the eclipse public license", "this program and the accompanying materials are made available under the terms of the eclipse public license (?:v |v|version )?1 0"),
    ("epl-2.0", "terms of the eclipse public license", "this program and the accompanying materials are made available under the terms of the eclipse public license (?:v |v|version )?2 0"),
    ("cddl", "terms of the common development and distribution license", "the contents of this file are subject to the terms of the common development and distribution license"),
    # Creative Commons deeds and addresses
    ("cc-by-4.0", "creativecommons org licenses by", "creativecommons org licenses by 4 0"),
    ("cc-by-sa-4.0", "creativecommons org licenses by", "creativecommons org licenses by sa 4 0"),
    ("cc-by-nc-4.0", "creativecommons org licenses by", "creativecommons org licenses by nc 4 0"),
    ("cc-by-nd-4.0", "creativecommons org licenses by", "creativecommons org licenses by nd 4 0"),
    ("cc-by-nc-sa-4.0", "creativecommons org licenses by", "creativecommons org licenses by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", "creativecommons org licenses by", "creativecommons org licenses by nc nd 4 0"),
    ("cc-by-3.0", "creativecommons org licenses by", "creativecommons org licenses by 3 0"),
    ("cc-by-sa-3.0", "creativecommons org licenses by", "creativecommons org licenses by sa 3 0"),
    ("cc-by-nc-3.0", "creativecommons org licenses by", "creativecommons org licenses by nc 3 0"),
    ("cc-by-nc-sa-3.0", "creativecommons org licenses by", "creativecommons org licenses by nc sa 3 0"),
    ("cc-by-nc-nd-3.0", "creativecommons org licenses by", "creativecommons org licenses by nc nd 3 0"),
    ("cc-by-2.0", "creativecommons org licenses by", "creativecommons org licenses by 2 0"),
    ("cc-by-sa-2.0", "creativecommons org licenses by", "creativecommons org licenses by sa 2 0"),
    ("cc-by-2.5", "creativecommons org licenses by", "creativecommons org licenses by 2 5"),
    ("cc0-1.0", "creativecommons org publicdomain zero", "creativecommons org publicdomain zero 1 0"),
    ("cc-pdm-1.0", "creativecommons org publicdomain mark", "creativecommons org publicdomain mark 1 0"),
    ("cc0-1.0", "has dedicated the work to the public domain", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc0-1.0", "waived all copyright and related", "(?:has|have) waived all copyright and related or neighboring rights"),
    ("cc-by", "you must give appropriate credit provide a link to the license", "you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("cc-sa", "contributions under the same license", "if you remix transform or build upon the material you must distribute your contributions under the same license as the original"),
    ("cc-nd", "you may not distribute the modified material", "if you remix transform or build upon the material you may not distribute the modified material"),
    # public domain and others
    ("unlicense", "unencumbered software released into the public domain", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy modify publish use compile sell", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "want to public license", "do what the fuck you want to public license"),
    ("beerware", "the beer ware license", "the beer ware license(?: revision 42)?"),
    ("beerware", "as long as you retain this notice you can do whatever", "as long as you retain this notice you can do whatever you want with this stuff"),
    ("ofl-1.1", "licensed under the sil open font license", "this font software is licensed under the sil open font license version 1 1"),
    ("openssl", "this product includes software developed by the openssl project", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ms-pl", "this license governs use of the accompanying software", "this license governs use of the accompanying software if you use the software you accept this license"),
    ("artistic-1.0", "copyright holder maintains some semblance of artistic control", "the copyright holder maintains some semblance of artistic control over the development of the package"),
    ("psf-2.0", "royalty free world wide license", "psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("json", "the software shall be used for good not evil", "the software shall be used for good not evil"),
    ("busl-1.1", "licensor hereby grants you the right to copy modify create derivative works", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("elastic-2.0", "you may not provide the software to third parties as a hosted", "you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", "the license does not include and the license does not grant to you the right to sell", "the license does not include and the license does not grant to you the right to sell the software"),
    ("proprietary", "unauthorized copying of this file", "unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "proprietary and confidential", "proprietary and confidential"),
)

#: Notices that put a work under a license.
NOTICES = (
    ("gpl-2.0-or-later", "gnu general public license", "gnu general public license as published by the free software foundation either version 2(?: of the license)? or (?:at your option )?any later version"),
    ("gpl-3.0-or-later", "gnu general public license", "gnu general public license as published by the free software foundation either version 3(?: of the license)? or (?:at your option )?any later version"),
    ("gpl-1.0-or-later", "gnu general public license", "gnu general public license as published by the free software foundation either version 1(?: of the license)? or (?:at your option )?any later version"),
    ("gpl-2.0-only", "gnu general public license", "gnu general public license version 2(?: 0)? (?:only )?as published by the free software foundation"),
    ("gpl-2.0-only", "gnu general public license", "gnu general public license as published by the free software foundation version 2(?: of the license)?(?! or)"),
    ("gpl-3.0-only", "gnu general public license", "gnu general public license version 3(?: 0)? (?:only )?as published by the free software foundation"),
    ("gpl-3.0-only", "gnu general public license", "gnu general public license as published by the free software foundation version 3(?: of the license)?(?! or)"),
    ("gpl-2.0-or-later", "gpl", "(?:gnu )?gplv?(?: version| v)? ?2(?: 0)? or (?:any )?(?:later|newer|higher)(?: version)?"),
    ("gpl-3.0-or-later", "gpl", "(?:gnu )?gplv?(?: version| v)? ?3(?: 0)? or (?:any )?(?:later|newer|higher)(?: version)?"),
    ("gpl-2.0-or-later", "gnu general public license", "gnu general public license (?:version |v ?)2(?: 0)? or (?:at your option )?(?:any )?later(?: version)?"),
    ("gpl-3.0-or-later", "gnu general public license", "gnu general public license (?:version |v ?)3(?: 0)? or (?:at your option )?(?:any )?later(?: version)?"),
    ("gpl-2.0-only", "gnu general public license", "gnu general public license (?:version |v ?)2(?: 0)? only"),
    ("gpl-3.0-only", "gnu general public license", "gnu general public license (?:version |v ?)3(?: 0)? only"),
    ("lgpl-2.0-or-later", "gnu library general public license", "gnu library general public license as published by the free software foundation either version 2(?: of the license)? or (?:at your option )?any later version"),
    ("lgpl-2.1-or-later", "gnu lesser general public license", "gnu lesser general public license as published by the free software foundation either version 2 1(?: of the license)? or (?:at your option )?any later version"),
    ("lgpl-3.0-or-later", "gnu lesser general public license", "gnu lesser general public license as published by the free software foundation either version 3(?: of the license)? or (?:at your option )?any later version"),
    ("lgpl-2.1-only", "gnu lesser general public license", "gnu lesser general public license (?:version 2 1 (?:only )?as published by the free software foundation|as published by the free software foundation version 2 1(?: of the license)?(?! or))"),
    ("lgpl-3.0-only", "gnu lesser general public license", "gnu lesser general public license (?:version 3 (?:only )?as published by the free software foundation|as published by the free software foundation version 3(?: of the license)?(?! or))"),
    ("agpl-3.0-or-later", "gnu affero general public license", "gnu affero general public license as published by the free software foundation either version 3(?: of the license)? or (?:at your option )?any later version"),
    ("agpl-3.0-only", "gnu affero general public license", "gnu affero general public license (?:version 3 (?:only )?as published by the free software foundation|as published by the free software foundation version 3(?: of the license)?(?! or))"),
    ("gfdl-1.1", "gnu free documentation license", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 1"),
    ("gfdl-1.2", "gnu free documentation license", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 2"),
    ("gfdl-1.3", "gnu free documentation license", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 3"),
    ("gpl", "a copy of the gnu general public license", "you should have received a copy of the gnu general public license along with"),
    ("lgpl", "general public license", "you should have received a copy of the gnu (?:lesser|library) general public license along with"),
    ("agpl", "a copy of the gnu affero general public license", "you should have received a copy of the gnu affero general public license along with"),
    ("apache-2.0", "apache", "(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?apache(?: software)?(?: license)?(?: version| v)? ?2(?: 0)?(?: license)?"),
    ("mit", "mit license", "(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?mit license"),
    ("bsd", "bsd", "(?:licensed|released|distributed|available|published) under (?:the |a )?(?:terms of )?(?:the )?bsd(?: style)? license"),
    ("bsd-2-clause", "bsd", "(?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:2 clause bsd|bsd 2 clause|simplified bsd)(?: license)?"),
    ("bsd-3-clause", "bsd", "(?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:3 clause bsd|bsd 3 clause|new bsd|modified bsd|revised bsd)(?: license)?"),
    ("isc", "isc license", "(?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?isc license"),
    ("gpl", "gnu general public license", "(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?gnu general public license"),
    ("gpl-2.0", "gnu general public license", "(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?gnu general public license (?:version |v ?)?2(?: 0)?"),
    ("gpl-3.0", "gnu general public license", "(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?gnu general public license (?:version |v ?)?3(?: 0)?"),
    ("lgpl", "general public license", "(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?gnu (?:lesser|library) general public license"),
    ("agpl", "gnu affero general public license", "(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?gnu affero general public license"),
    ("mpl-2.0", "mozilla public license", "(?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?mozilla public license (?:version |v ?)?2(?: 0)?"),
    ("eupl-1.2", "eupl", "licensed under the eupl(?: version| v)? ?1 2"),
    ("eupl-1.1", "eupl", "licensed under the eupl(?: version| v)? ?1 1"),
    ("cc-by", "creative commons attribution", "(?:licensed|released|published|available) under (?:a |the )?(?:terms of )?(?:the )?creative commons attribution(?: license)?"),
    ("cc0-1.0", "cc0", "(?:licensed|released|published|available|dedicated) under (?:the )?(?:terms of )?(?:the )?cc0(?: 1 0)?"),
    ("public-domain", "public domain", "(?:is|are|was|were|been|hereby) (?:released|placed|put|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", "public domain", "(?:this|the) (?:work|file|code|text|document|program|book|image) is in the public domain"),
    ("proprietary", "proprietary", "(?:licensed|released|distributed) under a proprietary license"),
    ("unlicense", "unlicense", "(?:licensed|released|distributed) under (?:the )?unlicense"),
    ("dual", "dual licensed under", "dual licensed under"),
)

#: Names with a version.
VERSIONS = (
    ("apache-2.0", "apache", "apache (?:software )?license (?:version |v ?)?2(?: 0)?"),
    ("apache-2.0", "apache", "apache (?:version |v ?)?2(?: 0)? license"),
    ("apache-1.1", "apache", "apache (?:software )?license (?:version |v ?)?1 1"),
    ("apache-1.0", "apache", "apache (?:software )?license (?:version |v ?)?1 0"),
    ("gpl-1.0", "gnu general public license", "gnu general public license (?:version |v ?)?1(?: 0)?"),
    ("gpl-2.0", "gnu general public license", "gnu general public license (?:version |v ?)?2(?: 0)?"),
    ("gpl-3.0", "gnu general public license", "gnu general public license (?:version |v ?)?3(?: 0)?"),
    ("gpl-2.0", "gpl", "(?:gnu )?(?:gpl (?:version |v ?)?2(?: 0)?|gplv2)"),
    ("gpl-3.0", "gpl", "(?:gnu )?(?:gpl (?:version |v ?)?3(?: 0)?|gplv3)"),
    ("lgpl-2.0", "general public license", "gnu (?:lesser|library) general public license (?:version |v ?)?2(?: 0)?(?! 1)"),
    ("lgpl-2.1", "general public license", "gnu (?:lesser|library) general public license (?:version |v ?)?2 1"),
    ("lgpl-3.0", "general public license", "gnu (?:lesser|library) general public license (?:version |v ?)?3(?: 0)?"),
    ("lgpl-2.1", "lgpl", "(?:gnu )?(?:lgpl (?:version |v ?)?2 1|lgplv2 1)"),
    ("lgpl-3.0", "lgpl", "(?:gnu )?(?:lgpl (?:version |v ?)?3(?: 0)?|lgplv3)"),
    ("agpl-3.0", "gnu affero general public license", "gnu affero general public license (?:version |v ?)?3(?: 0)?"),
    ("agpl-3.0", "agpl", "(?:gnu )?(?:agpl (?:version |v ?)?3(?: 0)?|agplv3)"),
    ("gfdl-1.1", "free documentation license", "gnu free documentation license (?:version |v ?)?1 1"),
    ("gfdl-1.2", "free documentation license", "gnu free documentation license (?:version |v ?)?1 2"),
    ("gfdl-1.3", "free documentation license", "gnu free documentation license (?:version |v ?)?1 3"),
    ("mpl-1.0", "mozilla public license", "mozilla public license (?:version |v ?)?1 0"),
    ("mpl-1.1", "mozilla public license", "mozilla public license (?:version |v ?)?1 1"),
    ("mpl-2.0", "mozilla public license", "mozilla public license (?:version |v ?)?2(?: 0)?"),
    ("epl-1.0", "eclipse public license", "eclipse public license (?:version |v ?)?1(?: 0)?"),
    ("epl-2.0", "eclipse public license", "eclipse public license (?:version |v ?)?2(?: 0)?"),
    ("cddl-1.0", "common development and distribution license", "common development and distribution license (?:cddl )?(?:version |v ?)?1(?: 0)?(?! 1)"),
    ("cddl-1.1", "common development and distribution license", "common development and distribution license (?:cddl )?(?:version |v ?)?1 1"),
    ("eupl-1.1", "european union public licen", "european union public licen[cs]e (?:eupl )?(?:version |v ?)?1 1"),
    ("eupl-1.2", "european union public licen", "european union public licen[cs]e (?:eupl )?(?:version |v ?)?1 2"),
    ("bsd-2-clause", "bsd", "(?:2 clause|two clause) bsd(?: license)?"),
    ("bsd-2-clause", "bsd", "bsd 2 clause(?: license)?"),
    ("bsd-2-clause", "bsd", "(?:simplified|freebsd) bsd license"),
    ("bsd-3-clause", "bsd", "(?:3 clause|three clause) bsd(?: license)?"),
    ("bsd-3-clause", "bsd", "bsd 3 clause(?: license)?"),
    ("bsd-3-clause", "bsd", "(?:new|modified|revised) bsd license"),
    ("bsd-4-clause", "bsd", "(?:original bsd license|bsd 4 clause|4 clause bsd|bsd with advertising clause)"),
    ("0bsd", "bsd", "(?:zero clause bsd|bsd zero clause|0bsd)(?: license)?"),
    ("bsl-1.0", "boost software license", "boost software license (?:version |v ?)?1(?: 0)?"),
    ("busl-1.1", "business source license", "business source license (?:version |v ?)?1 1"),
    ("artistic-1.0", "artistic license", "artistic license (?:version |v ?)?1(?: 0)?"),
    ("artistic-2.0", "artistic license", "artistic license (?:version |v ?)?2(?: 0)?"),
    ("ofl-1.0", "open font license", "(?:sil )?open font license (?:version |v ?)?1 0"),
    ("ofl-1.1", "open font license", "(?:sil )?open font license (?:version |v ?)?1 1"),
    ("odbl-1.0", "open database license", "open database license (?:odbl )?(?:version |v ?)?1(?: 0)?"),
    ("psf-2.0", "python software foundation license", "python software foundation license (?:version |v ?)?2"),
    ("php-3.01", "php license", "php license (?:version |v ?)?3 01"),
    ("php-3.0", "php license", "php license (?:version |v ?)?3 0"),
    ("osl-3.0", "open software license", "open software license (?:version |v ?)?3(?: 0)?"),
    ("afl-2.1", "academic free license", "academic free license (?:version |v ?)?2 1"),
    ("afl-3.0", "academic free license", "academic free license (?:version |v ?)?3(?: 0)?"),
    ("ecl-2.0", "educational community license", "educational community license (?:version |v ?)?2(?: 0)?"),
    ("upl-1.0", "universal permissive license", "universal permissive license (?:upl )?(?:version |v ?)?1(?: 0)?"),
    ("sspl-1.0", "server side public license", "server side public license (?:sspl )?(?:version |v ?)?1"),
    ("elastic-2.0", "elastic license", "elastic license (?:version |v ?)?2(?: 0)?"),
    ("cecill-2.1", "cecill", "cecill(?: free software)?(?: licen[cs]e)? (?:agreement )?(?:version |v ?)?2 1"),
    ("zpl-2.1", "zope public license", "zope public license (?:zpl )?(?:version |v ?)?2 1"),
    ("cc0-1.0", "cc0", "cc0 (?:version |v ?)?1 0(?: universal)?"),
    ("cc-by-4.0", "cc by", "cc by (?:version |v ?)?4(?: 0)?"),
    ("cc-by-3.0", "cc by", "cc by (?:version |v ?)?3(?: 0)?"),
    ("cc-by-2.0", "cc by", "cc by (?:version |v ?)?2 0"),
    ("cc-by-2.5", "cc by", "cc by (?:version |v ?)?2 5"),
    ("cc-by-1.0", "cc by", "cc by (?:version |v ?)?1 0"),
    ("cc-by-sa-4.0", "cc by", "cc by sa (?:version |v ?)?4(?: 0)?"),
    ("cc-by-sa-3.0", "cc by", "cc by sa (?:version |v ?)?3(?: 0)?"),
    ("cc-by-sa-2.0", "cc by", "cc by sa (?:version |v ?)?2 0"),
    ("cc-by-nc-4.0", "cc by", "cc by nc (?:version |v ?)?4(?: 0)?"),
    ("cc-by-nc-3.0", "cc by", "cc by nc (?:version |v ?)?3(?: 0)?"),
    ("cc-by-nd-4.0", "cc by", "cc by nd (?:version |v ?)?4(?: 0)?"),
    ("cc-by-nd-3.0", "cc by", "cc by nd (?:version |v ?)?3(?: 0)?"),
    ("cc-by-nc-sa-4.0", "cc by", "cc by nc sa (?:version |v ?)?4(?: 0)?"),
    ("cc-by-nc-sa-3.0", "cc by", "cc by nc sa (?:version |v ?)?3(?: 0)?"),
    ("cc-by-nc-nd-4.0", "cc by", "cc by nc nd (?:version |v ?)?4(?: 0)?"),
    ("cc-by-nc-nd-3.0", "cc by", "cc by nc nd (?:version |v ?)?3(?: 0)?"),
    ("cc-by-4.0", "creative commons attribution", "creative commons attribution (?:license )?(?:version |v ?)?4 0(?: international)?(?: license)?"),
    ("cc-by-sa-4.0", "creative commons attribution", "creative commons attribution share ?alike (?:license )?(?:version |v ?)?4 0(?: international)?(?: license)?"),
    ("cc-by-nc-4.0", "creative commons attribution", "creative commons attribution non ?commercial (?:license )?(?:version |v ?)?4 0(?: international)?(?: license)?"),
    ("cc-by-nd-4.0", "creative commons attribution", "creative commons attribution no ?deriv(?:ative|atives|s) (?:license )?(?:version |v ?)?4 0(?: international)?(?: license)?"),
    ("cc-by-nc-sa-4.0", "creative commons attribution", "creative commons attribution non ?commercial share ?alike (?:license )?(?:version |v ?)?4 0(?: international)?(?: license)?"),
    ("cc-by-nc-nd-4.0", "creative commons attribution", "creative commons attribution non ?commercial no ?deriv(?:ative|atives|s) (?:license )?(?:version |v ?)?4 0(?: international)?(?: license)?"),
    ("cc-by-3.0", "creative commons attribution", "creative commons attribution (?:license )?(?:version |v ?)?3 0(?: unported)?(?: license)?"),
    ("cc-by-sa-3.0", "creative commons attribution", "creative commons attribution share ?alike (?:license )?(?:version |v ?)?3 0(?: unported)?(?: license)?"),
    ("cc-by-nc-sa-3.0", "creative commons attribution", "creative commons attribution non ?commercial share ?alike (?:license )?(?:version |v ?)?3 0(?: unported)?(?: license)?"),
    ("cc-by-nc-sa-4.0", "licen", "attribution non ?commercial share ?alike 4 0 international(?: public)? licen[cs]e"),
    ("cc-by-sa-4.0", "licen", "attribution share ?alike 4 0 international(?: public)? licen[cs]e"),
    ("cc-by-4.0", "licen", "attribution 4 0 international(?: public)? licen[cs]e"),
)

#: Names alone.
NAMES = (
    ("apache", "apache", "apache (?:software )?license"),
    ("mit", "mit license", "mit license"),
    ("mit", "expat license", "expat license"),
    ("x11", "x11 license", "x11 license"),
    ("gpl", "gnu general public license", "gnu general public license"),
    ("gpl", "gpl", "gnu gpl"),
    ("lgpl", "general public license", "gnu (?:lesser|library) general public license"),
    ("lgpl", "lgpl", "gnu lgpl"),
    ("agpl", "gnu affero general public license", "gnu affero general public license"),
    ("agpl", "agpl", "gnu agpl"),
    ("gfdl", "free documentation license", "gnu free documentation license"),
    ("mpl", "mozilla public license", "mozilla public license"),
    ("epl", "eclipse public license", "eclipse public license"),
    ("cpl", "common public license", "common public license"),
    ("cddl", "common development and distribution license", "common development and distribution license"),
    ("eupl", "european union public licen", "european union public licen[cs]e"),
    ("bsd", "bsd", "bsd (?:style )?license"),
    ("isc", "isc license", "isc license"),
    ("zlib", "zlib", "zlib(?: libpng)? license"),
    ("bsl-1.0", "boost software license", "boost software license"),
    ("busl", "business source license", "business source license"),
    ("unlicense", "unlicense", "the unlicense"),
    ("artistic", "artistic license", "artistic license"),
    ("ofl", "open font license", "(?:sil )?open font license"),
    ("odbl", "open database license", "open database license"),
    ("odc-by", "open data commons attribution license", "open data commons attribution license"),
    ("pddl", "public domain dedication and license", "public domain dedication and license"),
    ("psf", "python software foundation license", "python software foundation license"),
    ("php", "php license", "php license"),
    ("ruby", "ruby license", "ruby license"),
    ("postgresql", "postgresql license", "postgresql license"),
    ("openssl", "openssl license", "openssl license"),
    ("ms-pl", "microsoft public license", "microsoft public license"),
    ("ms-rl", "microsoft reciprocal license", "microsoft reciprocal license"),
    ("osl", "open software license", "open software license"),
    ("afl", "academic free license", "academic free license"),
    ("ecl", "educational community license", "educational community license"),
    ("upl", "universal permissive license", "universal permissive license"),
    ("ncsa", "open source license", "(?:university of illinois )?ncsa open source license"),
    ("sspl", "server side public license", "server side public license"),
    ("elastic", "elastic license", "elastic license"),
    ("cecill", "cecill", "cecill(?: free software)?(?: licen[cs]e)?"),
    ("ipl", "ibm public license", "ibm public license"),
    ("qpl", "q public license", "q public license"),
    ("sleepycat", "sleepycat license", "sleepycat license"),
    ("vim", "vim license", "vim license"),
    ("w3c", "w3c software", "w3c software (?:notice and )?license"),
    ("zpl", "zope public license", "zope public license"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("cc0", "cc0", "cc0"),
    ("cc0", "creative commons zero", "creative commons zero"),
    ("cc-by", "cc by", "cc by"),
    ("cc-by-sa", "cc by", "cc by sa"),
    ("cc-by-nc", "cc by", "cc by nc"),
    ("cc-by-nd", "cc by", "cc by nd"),
    ("cc-by-nc-sa", "cc by", "cc by nc sa"),
    ("cc-by-nc-nd", "cc by", "cc by nc nd"),
    ("cc-by", "creative commons attribution", "creative commons attribution(?: license)?"),
    ("cc-by-sa", "creative commons attribution", "creative commons attribution share ?alike(?: license)?"),
    ("cc-by-nc", "creative commons attribution", "creative commons attribution non ?commercial(?: license)?"),
    ("cc-by-nc-sa", "creative commons attribution", "creative commons attribution non ?commercial share ?alike(?: license)?"),
    ("cc-by-nc-nd", "creative commons attribution", "creative commons attribution non ?commercial no ?deriv(?:ative|atives|s)(?: license)?"),
)
