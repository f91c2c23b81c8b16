"""Signature rules of license texts, headers, SPDX tags, addresses and notices, written out one by one.

A rule is (label, priority, keyword, expression, confidence). Expressions run over lower-cased words with single blanks
between them, so "GPL-2.0+" reads "gpl 2 0"; each of a rule's matches holds its keyword.
"""

#: Fixed values. Sentences of license texts.
TEXTS = [
    ("mit", 50, "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 1.0),
    ("mit", 49, "person obtaining a copy", "to any person obtaining a copy", 0.9),
    ("mit", 48, "to deal in the software without restriction", "to deal in the software without restriction including without limitation the rights", 0.95),
    ("mit", 47, "above copyright notice and this permission notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 0.95),
    ("mit-0", 55, "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software .{0,200}to do so the software is provided as is", 0.7),
    ("isc", 50, "permission to use copy modify", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 1.0),
    ("isc", 46, "permission to use copy modify", "permission to use copy modify(?: and| or| and or)? distribute this software for any purpose", 0.9),
    ("0bsd", 56, "permission to use copy modify", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is", 0.9),
    ("hpnd", 45, "permission to use copy modify", "permission to use copy modify(?: and)? distribute(?: and sell)? this software and its documentation for any purpose(?: and)? without fee is hereby granted", 0.95),
    ("bsd", 50, "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", 1.0),
    ("bsd", 44, "redistributions of source code must retain", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 0.95),
    ("bsd", 44, "redistributions in binary form must reproduce", "redistributions in binary form must reproduce the above copyright notice this list of conditions", 0.95),
    ("bsd-3-clause", 52, "endorse or promote products derived", "neither the name of .{1,80} nor the names of its contributors may be used to endorse or promote products derived from this software", 1.0),
    ("bsd-4-clause", 52, "advertising materials mentioning", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 1.0),
    ("bsd-clear", 53, "no express or implied licenses to any party", "no express or implied licenses to any party s patent rights are granted by this license", 1.0),
    ("apache", 50, "you may not use this file except in compliance", "you may not use this file except in compliance with the licen[cs]e", 1.0),
    ("apache", 45, "unless required by applicable law", "unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis", 1.0),
    ("apache", 45, "terms and conditions for use reproduction and distribution", "terms and conditions for use reproduction and distribution", 0.95),
    ("apache", 46, "perpetual worldwide non exclusive no charge royalty free irrevocable", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) license", 0.95),
    ("apache-1.1", 52, "software developed by the apache software foundation", "this product includes software developed by the apache software foundation", 0.95),
    ("gpl", 50, "under the terms of the gnu general public license as published", "(?:you can )?redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", 1.0),
    ("gpl", 45, "free software foundation", "under the terms of the gnu general public licen[cs]e as published by the free software foundation", 1.0),
    ("gpl", 44, "should have received a copy of the gnu general public license", "you should have received a copy of the gnu general public license along with this program", 0.95),
    ("gpl-2.0", 54, "version 2 of the license", "either version 2 of the license or at your option any later version", 0.95),
    ("gpl-2.0", 54, "version 2 june 1991", "gnu general public license version 2 june 1991", 1.0),
    ("gpl-3.0", 54, "version 3 of the license", "either version 3 of the license or at your option any later version", 0.95),
    ("gpl-3.0", 54, "version 3 29 june 2007", "gnu general public license version 3 29 june 2007", 1.0),
    ("gpl", 43, "free software foundation inc", "free software foundation inc (?:51 franklin (?:street|st)|59 temple place|675 mass ave)", 0.8),
    ("gpl", 42, "preamble the licenses for most software", "preamble the licenses for most software are designed to take away your freedom", 1.0),
    ("lgpl", 50, "gnu lesser general public license as published", "under the terms of the gnu lesser general public license as published by the free software foundation", 1.0),
    ("lgpl", 50, "gnu library general public license as published", "under the terms of the gnu library general public license as published by the free software foundation", 1.0),
    ("lgpl-2.1", 54, "version 2 1 february 1999", "gnu lesser general public license version 2 1 february 1999", 1.0),
    ("agpl", 50, "gnu affero general public license as published", "under the terms of the gnu affero general public license as published by the free software foundation", 1.0),
    ("agpl-3.0", 54, "version 3 19 november 2007", "gnu affero general public license version 3 19 november 2007", 1.0),
    ("agpl", 45, "interacting with it remotely", "all users interacting with it remotely through a computer network", 0.9),
    ("gfdl", 50, "gnu free documentation license", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 1.0),
    ("mpl", 50, "this source code form is subject to the terms", "this source code form is subject to the terms of the mozilla public licen[cs]e", 1.0),
    ("mpl-2.0", 54, "mozilla public license v", "mozilla public license v 2 0 if a copy of the mpl was not distributed with this file", 1.0),
    ("mpl-1.1", 54, "subject to the mozilla public license version", "the contents of this file are subject to the mozilla public license version 1 1", 1.0),
    ("epl", 50, "accompanying materials are made available under", "this program and the accompanying materials are made available under the terms of the eclipse public license", 1.0),
    ("cddl", 50, "common development and distribution license", "the contents of this file are subject to the terms of the common development and distribution license", 1.0),
    ("artistic", 50, "intent of this document is to state the conditions", "the intent of this document is to state the conditions under which a package may be copied", 1.0),
    ("artistic", 44, "same terms as perl itself", "(?:you can )?redistribute it and or modify it under the same terms as perl itself", 0.95),
    ("bsl", 50, "boost software license version", "boost software license version 1 0 august 17th 2003", 1.0),
    ("bsl", 45, "accompanying file license 1 0", "see accompanying file license 1 0 txt", 0.9),
    ("zlib", 50, "this software is provided as is without any express", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages", 1.0),
    ("zlib", 46, "altered source versions must be plainly marked", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 1.0),
    ("libpng", 50, "png reference library", "the png reference library is supplied as is", 1.0),
    ("libjpeg", 50, "independent jpeg group", "this software is based in part on the work of the independent jpeg group", 0.95),
    ("unlicense", 50, "free and unencumbered software", "this is free and unencumbered software released into the public domain", 1.0),
    ("wtfpl", 50, "you just do what the fuck you want to", "you just do what the fuck you want to", 1.0),
    ("cc0", 50, "waive all copyright and related or neighboring rights", "(?:hereby )?waive all copyright and related or neighboring rights", 0.95),
    ("cc0", 48, "affirmer hereby overtly fully permanently", "affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders", 1.0),
    ("cc-by", 42, "this work is licensed under a creative commons", "this work is licensed under a creative commons attribution(?: [0-9] [0-9])?(?: international| unported| generic)? license", 1.0),
    ("cc-by-sa", 44, "this work is licensed under a creative commons", "this work is licensed under a creative commons attribution share ?alike(?: [0-9] [0-9])?(?: international| unported| generic)? license", 1.0),
    ("cc-by-nc", 44, "this work is licensed under a creative commons", "this work is licensed under a creative commons attribution non ?commercial(?: [0-9] [0-9])?(?: international| unported| generic)? license", 1.0),
    ("cc-by-nd", 44, "this work is licensed under a creative commons", "this work is licensed under a creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [0-9] [0-9])?(?: international| unported| generic)? license", 1.0),
    ("cc-by-nc-sa", 45, "this work is licensed under a creative commons", "this work is licensed under a creative commons attribution non ?commercial share ?alike(?: [0-9] [0-9])?(?: international| unported| generic)? license", 1.0),
    ("cc-by-nc-nd", 45, "this work is licensed under a creative commons", "this work is licensed under a creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: [0-9] [0-9])?(?: international| unported| generic)? license", 1.0),
    ("ofl", 50, "this font software is licensed under", "this font software is licensed under the sil open font license version 1 1", 1.0),
    ("openssl", 50, "openssl project for use in the openssl toolkit", "this product includes software developed by the openssl project for use in the openssl toolkit", 1.0),
    ("ssleay", 50, "cryptographic software written by eric young", "this product includes cryptographic software written by eric young", 1.0),
    ("psf", 50, "python software foundation license version", "python software foundation license version 2", 1.0),
    ("psf", 45, "psf hereby grants licensee", "psf hereby grants licensee a nonexclusive royalty free world wide license", 1.0),
    ("php", 50, "subject to version 3", "this source file is subject to version 3 0?1? ?of the php license", 1.0),
    ("postgresql", 50, "postgresql global development group", "portions copyright c [0-9 ]+ postgresql global development group", 0.9),
    ("ncsa", 50, "university of illinois", "developed by .{1,80} university of illinois at urbana champaign", 0.8),
    ("ms-pl", 50, "this license governs use of the accompanying software", "this license governs use of the accompanying software if you use the software you accept this license", 0.9),
    ("eupl", 50, "licensed under the eupl", "licensed under the eupl version 1 [0-2] or as soon they will be approved", 1.0),
    ("sspl", 50, "functionality of the program or modified version", "making the functionality of the program or modified version available to third parties as a service", 0.9),
    ("busl", 50, "licensor hereby grants you the right", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use", 1.0),
    ("elastic", 50, "you may not provide the software to third parties", "you may not provide the software to third parties as a hosted or managed service", 1.0),
    ("commons-clause", 50, "commons clause", "commons clause(?: license condition)?", 0.9),
    ("jquery", 50, "dual licensed under the mit or gpl", "dual licensed under the mit or gpl version 2 licenses", 1.0),
    ("ijg", 45, "independent jpeg group", "the independent jpeg group s (?:jpeg )?software", 0.8),
    ("curl", 50, "permission to use copy modify", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice", 0.8),
    ("ntp", 50, "permission to use copy modify", "permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted", 0.95),
    ("vim", 50, "there are no restrictions on distributing unmodified copies", "there are no restrictions on distributing unmodified copies of vim", 1.0),
    ("ruby", 50, "same terms as ruby", "(?:redistribute it and or modify it )?under the same terms as ruby", 0.95),
    ("lppl", 50, "latex project public license", "(?:conditions of the )?latex project public license(?: either version [0-9 ]+)?", 1.0),
    ("json", 50, "used for good not evil", "the software shall be used for good not evil", 1.0),
    ("beerware", 50, "buy me a beer", "you can buy me a beer in return", 1.0),
    ("openrail", 50, "use based restrictions", "use based restrictions(?: as referenced in paragraph [0-9]+)?", 0.7),
    ("llama", 50, "built with llama", "built with llama", 0.8),
    ("odbl", 50, "open database license", "this .{1,60} is made available under the open database license", 1.0),
    ("ogl", 50, "open government licence", "(?:contains public sector information )?licensed under the open government licence(?: v?[0-9] ?[0-9]?)?", 1.0),
]
#: Fixed values. Tags and identifiers of one line.
TAGS = [
    ("mit", 42, "spdx license identifier", "spdx license identifier mit", 1.0),
    ("mit-0", 43, "spdx license identifier", "spdx license identifier mit 0", 1.0),
    ("apache-2.0", 43, "spdx license identifier", "spdx license identifier apache 2 0", 1.0),
    ("gpl-2.0", 43, "spdx license identifier", "spdx license identifier gpl 2 0(?: only| or later)?", 1.0),
    ("gpl-3.0", 43, "spdx license identifier", "spdx license identifier gpl 3 0(?: only| or later)?", 1.0),
    ("lgpl-2.1", 43, "spdx license identifier", "spdx license identifier lgpl 2 1(?: only| or later)?", 1.0),
    ("lgpl-3.0", 43, "spdx license identifier", "spdx license identifier lgpl 3 0(?: only| or later)?", 1.0),
    ("agpl-3.0", 43, "spdx license identifier", "spdx license identifier agpl 3 0(?: only| or later)?", 1.0),
    ("bsd-2-clause", 43, "spdx license identifier", "spdx license identifier bsd 2 clause", 1.0),
    ("bsd-3-clause", 43, "spdx license identifier", "spdx license identifier bsd 3 clause", 1.0),
    ("0bsd", 43, "spdx license identifier", "spdx license identifier 0bsd", 1.0),
    ("isc", 43, "spdx license identifier", "spdx license identifier isc", 1.0),
    ("mpl-2.0", 43, "spdx license identifier", "spdx license identifier mpl 2 0", 1.0),
    ("epl-1.0", 43, "spdx license identifier", "spdx license identifier epl 1 0", 1.0),
    ("epl-2.0", 43, "spdx license identifier", "spdx license identifier epl 2 0", 1.0),
    ("cddl-1.0", 43, "spdx license identifier", "spdx license identifier cddl 1 0", 1.0),
    ("eupl-1.2", 43, "spdx license identifier", "spdx license identifier eupl 1 2", 1.0),
    ("artistic-2.0", 43, "spdx license identifier", "spdx license identifier artistic 2 0", 1.0),
    ("bsl", 43, "spdx license identifier", "spdx license identifier bsl 1 0", 1.0),
    ("zlib", 43, "spdx license identifier", "spdx license identifier zlib", 1.0),
    ("unlicense", 43, "spdx license identifier", "spdx license identifier unlicense", 1.0),
    ("wtfpl", 43, "spdx license identifier", "spdx license identifier wtfpl", 1.0),
    ("cc0", 43, "spdx license identifier", "spdx license identifier cc0 1 0", 1.0),
    ("cc-by", 43, "spdx license identifier", "spdx license identifier cc by [1-4] 0", 1.0),
    ("cc-by-sa", 44, "spdx license identifier", "spdx license identifier cc by sa [1-4] 0", 1.0),
    ("cc-by-nc", 44, "spdx license identifier", "spdx license identifier cc by nc [1-4] 0", 1.0),
    ("cc-by-nc-sa", 44, "spdx license identifier", "spdx license identifier cc by nc sa [1-4] 0", 1.0),
    ("psf", 43, "spdx license identifier", "spdx license identifier psf 2 0", 1.0),
    ("ofl", 43, "spdx license identifier", "spdx license identifier ofl 1 1", 1.0),
    ("odbl", 43, "spdx license identifier", "spdx license identifier odbl 1 0", 1.0),
    ("sspl", 43, "spdx license identifier", "spdx license identifier sspl 1 0", 1.0),
    ("busl", 43, "spdx license identifier", "spdx license identifier busl 1 1", 1.0),
    ("gpl-classpath", 45, "spdx license identifier", "spdx license identifier gpl 2 0(?: only| or later)? with classpath exception 2 0", 1.0),
    ("gpl-syscall", 45, "spdx license identifier", "spdx license identifier gpl 2 0(?: only| or later)? with linux syscall note", 1.0),
    ("llvm", 45, "spdx license identifier", "spdx license identifier apache 2 0 with llvm exception", 1.0),
    ("mit", 30, "license osi approved", "license osi approved mit license", 0.95),
    ("apache", 30, "license osi approved", "license osi approved apache software license", 0.95),
    ("bsd", 30, "license osi approved", "license osi approved bsd license", 0.95),
    ("gpl", 30, "license osi approved", "license osi approved gnu general public license(?: v[23])?", 0.95),
    ("lgpl", 30, "license osi approved", "license osi approved gnu lesser general public license(?: v[23])?", 0.95),
    ("mpl", 30, "license osi approved", "license osi approved mozilla public license", 0.95),
    ("mit", 29, "module license", "module license (?:dual )?mit(?: gpl)?", 0.8),
    ("gpl", 29, "module license", "module license gpl(?: v2)?", 0.9),
    ("bsd", 29, "module license", "module license dual bsd gpl", 0.9),
    ("mit", 28, "license mit", "license mit", 0.7),
    ("apache", 28, "license apache", "license apache (?:2|2 0)", 0.7),
    ("gpl", 28, "license gpl", "license gpl ?v?[23](?: 0)?", 0.7),
    ("lgpl", 28, "license lgpl", "license lgpl ?v?[23](?: [01])?", 0.7),
    ("bsd", 28, "license bsd", "license bsd(?: [234] clause)?", 0.7),
    ("isc", 28, "license isc", "license isc", 0.7),
    ("mpl", 28, "license mpl", "license mpl 2(?: 0)?", 0.7),
    ("unlicense", 28, "license unlicense", "license unlicense", 0.7),
    ("cc0", 28, "license cc0", "license cc0(?: 1 0)?", 0.7),
    ("gpl", 27, "gplv", "gplv[23]", 0.8),
    ("lgpl", 27, "lgplv", "lgplv(?:2|2 1|3)", 0.8),
    ("agpl", 27, "agplv", "agplv3", 0.8),
]
#: Fixed values. Web addresses of license texts.
ADDRESSES = [
    ("apache", 35, "apache org licenses", "(?:http|https) (?:www )?apache org licenses license 2 0", 0.95),
    ("apache", 34, "apache org licenses", "apache org licenses license 2 0", 0.9),
    ("gpl", 35, "gnu org licenses", "gnu org licenses(?: old licenses)? gpl(?: [0-9] [0-9])?", 0.9),
    ("lgpl", 35, "gnu org licenses", "gnu org licenses(?: old licenses)? lgpl(?: [0-9] [0-9])?", 0.9),
    ("agpl", 35, "gnu org licenses", "gnu org licenses agpl(?: [0-9] [0-9])?", 0.9),
    ("gfdl", 35, "gnu org licenses", "gnu org licenses fdl(?: [0-9] [0-9])?", 0.9),
    ("gpl", 33, "gnu org copyleft", "gnu org copyleft gpl", 0.9),
    ("lgpl", 33, "gnu org copyleft", "gnu org copyleft lesser", 0.9),
    ("mit", 35, "opensource org licenses", "opensource org licenses mit(?: license)?", 0.95),
    ("bsd", 35, "opensource org licenses", "opensource org licenses bsd(?: license| [23] clause)?", 0.95),
    ("apache", 35, "opensource org licenses", "opensource org licenses apache 2 0", 0.95),
    ("isc", 35, "opensource org licenses", "opensource org licenses isc", 0.95),
    ("gpl", 35, "opensource org licenses", "opensource org licenses gpl (?:license|[23] 0)", 0.95),
    ("lgpl", 35, "opensource org licenses", "opensource org licenses lgpl (?:license|2 1|3 0)", 0.95),
    ("mpl", 35, "opensource org licenses", "opensource org licenses mpl 2 0", 0.95),
    ("zlib", 35, "opensource org licenses", "opensource org licenses zlib", 0.95),
    ("artistic", 35, "opensource org licenses", "opensource org licenses artistic license 2 0", 0.95),
    ("mpl", 35, "mozilla org mpl", "mozilla org mpl(?: 2 0)?", 0.9),
    ("mpl", 34, "mpl mozilla org", "mpl mozilla org(?: mpl)?(?: 2 0)?", 0.9),
    ("epl", 35, "eclipse org legal", "eclipse org legal epl (?:v10|v20|2 0)", 0.95),
    ("bsl", 35, "boost org license", "boost org license 1 0 txt", 0.95),
    ("cddl", 35, "opensolaris org os licensing", "opensolaris org os licensing", 0.9),
    ("ofl", 35, "scripts sil org", "scripts sil org ofl", 0.95),
    ("unlicense", 35, "unlicense org", "unlicense org", 0.9),
    ("wtfpl", 35, "wtfpl net", "wtfpl net", 0.9),
    ("zlib", 35, "zlib net", "zlib net zlib license", 0.95),
    ("python", 35, "python org", "python org (?:3 )?license", 0.6),
    ("php", 35, "php net license", "php net license(?: 3 0?1?)?", 0.9),
    ("cc0", 35, "creativecommons org publicdomain", "creativecommons org publicdomain zero 1 0", 1.0),
    ("public-domain", 35, "creativecommons org publicdomain", "creativecommons org publicdomain mark 1 0", 1.0),
    ("cc-by", 35, "creativecommons org licenses", "creativecommons org licenses by [0-9]", 0.9),
    ("cc-by-sa", 36, "creativecommons org licenses", "creativecommons org licenses by sa", 0.9),
    ("cc-by-nd", 36, "creativecommons org licenses", "creativecommons org licenses by nd", 0.9),
    ("cc-by-nc", 36, "creativecommons org licenses", "creativecommons org licenses by nc(?! sa| nd)", 0.9),
    ("cc-by-nc-sa", 36, "creativecommons org licenses", "creativecommons org licenses by nc sa", 0.9),
    ("cc-by-nc-nd", 36, "creativecommons org licenses", "creativecommons org licenses by nc nd", 0.9),
    ("odbl", 35, "opendatacommons org licenses", "opendatacommons org licenses odbl", 0.95),
    ("odc-by", 35, "opendatacommons org licenses", "opendatacommons org licenses by", 0.95),
    ("pddl", 35, "opendatacommons org licenses", "opendatacommons org licenses pddl", 0.95),
    ("ogl", 35, "nationalarchives gov uk", "nationalarchives gov uk doc open government licence", 0.95),
    ("eupl", 35, "joinup ec europa eu", "joinup ec europa eu .{0,60}eupl", 0.8),
    ("lppl", 35, "latex project org lppl", "latex project org lppl", 0.95),
    ("sspl", 35, "mongodb com licensing", "mongodb com licensing server side public license", 0.95),
    ("elastic", 35, "elastic co licensing", "elastic co licensing elastic license", 0.95),
    ("openrail", 35, "bigscience huggingface co", "bigscience huggingface co blog (?:the )?bigscience rail license", 0.9),
]
#: Fixed values. Headers of files, notices and disclaimers.
NOTICES = [
    ("mit", 32, "mit style license", "(?:use of this source code is governed by an |under an |an )?mit style license", 0.9),
    ("bsd", 32, "bsd style license", "(?:use of this source code is governed by a |under a |a )?bsd style license(?: that can be found in the license file)?", 0.95),
    ("apache", 31, "asf under one or more contributor license agreements", "licensed to the apache software foundation asf under one or more contributor license agreements", 1.0),
    ("mit", 32, "released under the mit", "released under the mit(?: licen[cs]e)?", 0.95),
    ("mit", 32, "licensed under the mit", "licensed under the mit(?: license)?", 0.95),
    ("mit", 31, "license the mit license", "license the mit license", 0.9),
    ("bsd", 32, "licensed under the bsd", "licensed under the bsd(?: [234] clause)?(?: license)?", 0.95),
    ("gpl", 32, "licensed under the gpl", "licensed under the gpl(?: ?v?[23])?(?: license)?", 0.95),
    ("gpl", 31, "released under the gpl", "released under the gpl(?: ?v?[23])?", 0.95),
    ("gpl", 31, "covered by the gpl", "covered by the gpl", 0.9),
    ("gpl", 30, "gpl compatible", "gpl compatible(?: licen[cs]es?)?", 0.4),
    ("gpl", 33, "with the classpath exception", "with the classpath exception", 0.8),
    ("lgpl", 32, "licensed under the lgpl", "licensed under the lgpl(?: ?v?[23](?: 1)?)?", 0.95),
    ("agpl", 32, "licensed under the agpl", "licensed under the agpl(?: ?v?3)?", 0.95),
    ("apache", 32, "apache 2 0 license", "(?:under )?(?:the )?apache 2 0 license", 0.9),
    ("apache", 31, "apache license version 2 0", "apache license version 2 0(?: january 2004)?", 0.95),
    ("mpl", 32, "mpl 1 1 gpl 2 0 lgpl 2 1", "mpl 1 1 gpl 2 0 lgpl 2 1", 1.0),
    ("cc-by", 30, "cc by license", "(?:under (?:a |the )?)?cc by license", 0.9),
    ("cc-by-sa", 31, "cc by sa license", "(?:under (?:a |the )?)?cc by sa license", 0.9),
    ("cc-by", 30, "attribution 4 0 international", "attribution 4 0 international(?: cc by 4 0)?", 0.9),
    ("cc-by-sa", 31, "attribution sharealike", "attribution sharealike [1-4] [05](?: international| unported| generic)?", 0.9),
    ("cc-by-nc", 31, "attribution noncommercial", "attribution noncommercial [1-4] [05](?: international| unported| generic)?", 0.9),
    ("cc-by-nc-sa", 32, "attribution noncommercial sharealike", "attribution noncommercial sharealike [1-4] [05](?: international| unported| generic)?", 0.9),
    ("cc-by-nc-nd", 32, "attribution noncommercial noderivatives", "attribution noncommercial noderivatives [1-4] [05](?: international| unported| generic)?", 0.9),
    ("cc0", 31, "public domain dedication", "cc0 1 0 universal(?: cc0 1 0)? public domain dedication", 1.0),
    ("public-domain", 31, "placed in the public domain", "(?:is |has been |are )?(?:hereby )?placed in the public domain", 0.9),
    ("public-domain", 31, "released into the public domain", "(?:is |has been |are )?(?:hereby )?released into the public domain", 0.9),
    ("public-domain", 31, "dedicated to the public domain", "(?:is |has been |are )?(?:hereby )?dedicated to the public domain", 0.9),
    ("public-domain", 30, "this file is in the public domain", "this file is in the public domain", 0.9),
    ("public-domain", 30, "no copyright is claimed", "no copyright is claimed", 0.7),
    ("public-domain", 30, "the author disclaims copyright", "the author disclaims copyright to this source code", 0.95),
    ("all-rights-reserved", 20, "all rights reserved", "(?:copyright c? ?[0-9 ]{0,40}.{0,60})?all rights reserved", 0.5),
    ("proprietary", 32, "confidential and proprietary", "(?:this (?:software|document|file) is )?confidential and proprietary", 0.8),
    ("proprietary", 32, "unauthorized copying of this file", "unauthorized copying of this file via any medium is strictly prohibited", 1.0),
    ("proprietary", 32, "no part of this publication may be reproduced", "no part of this publication may be reproduced(?: distributed or transmitted)?", 0.95),
    ("proprietary", 31, "may not be reproduced without", "may not be reproduced without (?:the )?(?:prior )?(?:written )?permission", 0.8),
    ("proprietary", 31, "reproduction without permission is prohibited", "reproduction without permission is prohibited", 0.9),
    ("proprietary", 31, "end user license agreement", "(?:this )?end user license agreement(?: eula)?", 0.8),
    ("proprietary", 30, "trade secret", "contains trade secrets?(?: and proprietary information)?", 0.7),
    ("non-commercial", 31, "for non commercial use only", "for non commercial use only", 0.9),
    ("non-commercial", 31, "for personal use only", "for personal use only", 0.7),
    ("research-only", 31, "for research purposes only", "for research purposes only", 0.8),
    ("research-only", 31, "research and educational use", "(?:for )?research and educational use only", 0.8),
    ("no-training", 33, "not be used to train", "(?:may|must|shall) not be used to train(?: any)?(?: artificial intelligence| machine learning| ai)?", 0.9),
    ("no-training", 33, "text and data mining", "(?:rights reserved for|reserves? all rights to|opt(?:s|ed)? out of) text and data mining", 0.9),
    ("warranty-disclaimer", 15, "without warranty of any kind", "(?:is provided )?as is without warranty of any kind(?: express or implied)?", 0.4),
    ("warranty-disclaimer", 15, "without even the implied warranty", "without even the implied warranty of merchantability or fitness for a particular purpose", 0.5),
    ("warranty-disclaimer", 15, "in no event shall", "in no event shall (?:the )?(?:authors?|copyright holders?|contributors?)(?: or (?:authors?|copyright holders?|contributors?))* be liable", 0.4),
    ("patent-grant", 25, "additional grant of patent rights", "an additional grant of patent rights can be found in the patents file", 0.9),
    ("contributor-agreement", 25, "contributor license agreement", "contributor license agreements?(?: cla)?", 0.5),
    ("contributor-agreement", 25, "developer certificate of origin", "developer certificate of origin(?: version 1 1)?", 0.5),
    ("export-control", 25, "export administration regulations", "subject to (?:the )?(?:u s |us )?export administration regulations", 0.5),
]
RULES = TEXTS + TAGS + ADDRESSES + NOTICES
