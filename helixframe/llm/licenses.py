"""License scans by ordered signature rules, with DataFrame functions only.

A text is lower-cased (A-Z) and reduced to its words, one space around each.
A signature is a hand-written expression over those words with keywords, a
priority and a confidence.  One look-up of a text's words among all keywords
tells which signatures can match; only these are tried.

Detections that overlap are resolved by priority and containment: one goes if
a detection of higher priority overlaps it, wherever that begins, or if one of
the same priority contains it (of equal spans the earlier signature stays).

Priorities: 5 identifiers in a field and sentences that only one license text
has; 4 grants that name a license; 3 names with their version; 2 short
identifiers; 1 names in passing.

Defined results: a null or empty text has no words, no places, null first and
last words, empty labels and score 0; texts of any length are scanned whole;
repeated rows are scanned each; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

_L = "licen[cs]es?"
_GRANTED = "(?:licen[cs]ed|released|distributed|available|provided|published|shared|offered|covered|governed|redistributed)"
_UNDER = _GRANTED + " (?:under|by) (?:the )?(?:terms (?:and conditions )?of (?:the )?|conditions of (?:the )?)?"
_V = " ?(?:version |v ?)?"
_BY = "(?:by|attribution)"
_NC = "(?:nc|non ?commercial)"
_SA = "(?:sa|share ?alike)"
_ND = "(?:nd|no ?deriv(?:s|atives|ative works))"
_CCV = "(?: " + _L + ")?(?: (?:version )?[1234] [05])?(?: (?:international|unported|generic|united states))?(?: " + _L + ")?"
_LATER = "(?: only| or later| or any later version| or at your option any later version)?"

#: Signatures, earlier ones first where spans are equal: label, priority, confidence, keywords that a text must all have, expression.
SIGNATURES = (
    # Identifiers in a field.
    ("0bsd", 5, 1.0, "spdx 0bsd", "spdx license identifier 0bsd"),
    ("afl-3", 5, 1.0, "spdx afl", "spdx license identifier afl 3 0"),
    ("agpl-3", 5, 1.0, "spdx agpl", "spdx license identifier agpl 3 0" + _LATER),
    ("apache-1", 5, 1.0, "spdx apache", "spdx license identifier apache 1 [01]"),
    ("apache-2", 5, 1.0, "spdx apache", "spdx license identifier apache 2 0(?: with llvm exception)?"),
    ("apsl-2", 5, 1.0, "spdx apsl", "spdx license identifier apsl 2 0"),
    ("artistic-2", 5, 1.0, "spdx artistic", "spdx license identifier artistic 2 0"),
    ("artistic-1", 5, 1.0, "spdx artistic", "spdx license identifier artistic 1 0(?: perl)?"),
    ("blueoak-1", 5, 1.0, "spdx blueoak", "spdx license identifier blueoak 1 0 0"),
    ("bsd-2-clause", 5, 1.0, "spdx bsd", "spdx license identifier bsd 2 clause(?: patent)?"),
    ("bsd-3-clause", 5, 1.0, "spdx bsd", "spdx license identifier bsd 3 clause(?: clear)?"),
    ("bsd-4-clause", 5, 1.0, "spdx bsd", "spdx license identifier bsd 4 clause"),
    ("bsl-1", 5, 1.0, "spdx bsl", "spdx license identifier bsl 1 0"),
    ("busl-1", 5, 1.0, "spdx busl", "spdx license identifier busl 1 1"),
    ("cc0", 5, 1.0, "spdx cc0", "spdx license identifier cc0 1 0"),
    ("cc-by", 5, 1.0, "spdx cc", "spdx license identifier cc by [1234] [05]"),
    ("cc-by-sa", 5, 1.0, "spdx cc", "spdx license identifier cc by sa [1234] [05]"),
    ("cc-by-nc", 5, 1.0, "spdx cc", "spdx license identifier cc by nc [1234] [05]"),
    ("cc-by-nc-sa", 5, 1.0, "spdx cc", "spdx license identifier cc by nc sa [1234] [05]"),
    ("cddl-1", 5, 1.0, "spdx cddl", "spdx license identifier cddl 1 [01]"),
    ("cecill-2", 5, 1.0, "spdx cecill", "spdx license identifier cecill 2 [01]"),
    ("epl-1", 5, 1.0, "spdx epl", "spdx license identifier epl 1 0"),
    ("epl-2", 5, 1.0, "spdx epl", "spdx license identifier epl 2 0"),
    ("eupl-1", 5, 1.0, "spdx eupl", "spdx license identifier eupl 1 [012]"),
    ("gfdl-1", 5, 1.0, "spdx gfdl", "spdx license identifier gfdl 1 [123]" + _LATER),
    ("gpl-2", 5, 1.0, "spdx gpl", "spdx license identifier gpl 2 0" + _LATER),
    ("gpl-3", 5, 1.0, "spdx gpl", "spdx license identifier gpl 3 0" + _LATER),
    ("isc", 5, 1.0, "spdx isc", "spdx license identifier isc"),
    ("lgpl-2", 5, 1.0, "spdx lgpl", "spdx license identifier lgpl 2 [01]" + _LATER),
    ("lgpl-3", 5, 1.0, "spdx lgpl", "spdx license identifier lgpl 3 0" + _LATER),
    ("mit", 5, 1.0, "spdx mit", "spdx license identifier mit(?: 0)?"),
    ("mpl-1", 5, 1.0, "spdx mpl", "spdx license identifier mpl 1 [01]"),
    ("mpl-2", 5, 1.0, "spdx mpl", "spdx license identifier mpl 2 0(?: no copyleft exception)?"),
    ("ms-pl", 5, 1.0, "spdx pl", "spdx license identifier ms pl"),
    ("odbl-1", 5, 1.0, "spdx odbl", "spdx license identifier odbl 1 0"),
    ("ofl-1", 5, 1.0, "spdx ofl", "spdx license identifier ofl 1 [01]"),
    ("postgresql", 5, 1.0, "spdx postgresql", "spdx license identifier postgresql"),
    ("psf-2", 5, 1.0, "spdx psf", "spdx license identifier psf 2 0"),
    ("unlicense", 5, 1.0, "spdx unlicense", "spdx license identifier unlicense"),
    ("upl-1", 5, 1.0, "spdx upl", "spdx license identifier upl 1 0"),
    ("wtfpl", 5, 1.0, "spdx wtfpl", "spdx license identifier wtfpl"),
    ("zlib", 5, 1.0, "spdx zlib", "spdx license identifier zlib"),
    # Sentences that only one license text has, and their near relatives.
    ("mit", 5, 1.0, "permission restriction", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", 5, 0.9, "permission charge", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", 5, 0.9, "notice portions", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-0", 5, 0.9, "sublicense restriction", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided as is"),
    ("x11", 5, 0.9, "consortium advertising", "except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("isc", 5, 1.0, "permission fee", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("0bsd", 5, 1.0, "permission fee", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("hpnd", 5, 0.9, "permission fee", "permission to use copy modify and distribute this software and its documentation for any purpose(?: and)? without fee is hereby granted"),
    ("bsd-2-clause", 5, 0.9, "redistribution binary", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-3-clause", 5, 1.0, "neither endorse", "neither the name of (?:the )?(?:[^ ]+ ){1,8}nor the names of (?:its|any|their) contributors may be used to endorse or promote products"),
    ("bsd-4-clause", 5, 1.0, "advertising acknowledgement", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("apache-2", 5, 1.0, "apache compliance", "you may not use this file except in compliance with the license you may obtain a copy of the license at https? www apache org licenses license 2 0"),
    ("apache-2", 5, 0.9, "apache licenses", "(?:https? )?www apache org licenses license 2 0(?: (?:txt|html))?"),
    ("apache-1", 5, 0.9, "apache product", "this product includes software developed by the apache (?:group|software foundation)"),
    ("gpl-2", 5, 1.0, "gnu redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3", 5, 1.0, "gnu redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2", 5, 1.0, "gnu redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license version 2(?: only)? as published by the free software foundation"),
    ("lgpl-2", 5, 1.0, "gnu lesser redistribute", "you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license as published by the free software foundation either version 2(?: 1)? of the license or at your option any later version"),
    ("lgpl-3", 5, 1.0, "gnu lesser redistribute", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl-3", 5, 1.0, "gnu affero redistribute", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl", 5, 0.8, "gnu along", "you should have received a copy of the gnu general public license along with this program"),
    ("lgpl", 5, 0.8, "gnu lesser along", "you should have received a copy of the gnu lesser general public license along with this (?:program|library)"),
    ("agpl-3", 5, 0.9, "gnu affero along", "you should have received a copy of the gnu affero general public license along with this program"),
    ("gfdl-1", 5, 1.0, "gnu documentation", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 [123]"),
    ("mpl-2", 5, 1.0, "mozilla form", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1", 5, 1.0, "mozilla contents", "the contents of this file are subject to the mozilla public license version 1 [01]"),
    ("cddl-1", 5, 1.0, "development contents", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("epl-1", 5, 1.0, "eclipse accompanying", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("epl-2", 5, 1.0, "eclipse accompanying", "this program and the accompanying materials are made available under the terms of the eclipse public license (?:v ?)?2 0"),
    ("bsl-1", 5, 1.0, "boost distributed", "distributed under the boost software license version 1 0"),
    ("zlib", 5, 1.0, "misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", 5, 0.9, "arising damages", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("unlicense", 5, 1.0, "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", 5, 1.0, "fuck", "you just do what the fuck you want to"),
    ("beerware", 5, 1.0, "beer", "(?:if we meet some day and you think this stuff is worth it )?you can buy me a beer in return"),
    ("cc0", 5, 1.0, "domain dedicated", "has dedicated the work to the public domain by waiving all of (?:his or her|their) rights"),
    ("cc0", 5, 0.9, "waived copyright", "to the extent possible under law (?:[^ ]+ ){1,8}waived all copyright and related or neighboring rights"),
    ("cc-by", 5, 0.9, "creativecommons", "(?:https? )?creativecommons org licenses by [1234] [05]"),
    ("cc-by-sa", 5, 0.9, "creativecommons", "(?:https? )?creativecommons org licenses by sa [1234] [05]"),
    ("cc-by-nd", 5, 0.9, "creativecommons", "(?:https? )?creativecommons org licenses by nd [1234] [05]"),
    ("cc-by-nc", 5, 0.9, "creativecommons", "(?:https? )?creativecommons org licenses by nc [1234] [05]"),
    ("cc-by-nc-sa", 5, 0.9, "creativecommons", "(?:https? )?creativecommons org licenses by nc sa [1234] [05]"),
    ("cc-by-nc-nd", 5, 0.9, "creativecommons", "(?:https? )?creativecommons org licenses by nc nd [1234] [05]"),
    ("cc0", 5, 0.9, "creativecommons", "(?:https? )?creativecommons org publicdomain zero 1 0"),
    ("ofl-1", 5, 1.0, "sil font", "this font software is licensed under the sil open font license"),
    ("openssl", 5, 1.0, "openssl toolkit", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("php-3", 5, 1.0, "php freely", "this product includes php software freely available from https? (?:www )?php net software"),
    ("psf-2", 5, 1.0, "psf making", "psf is making python available to licensee on an as is basis"),
    ("ms-pl", 5, 0.9, "accompanying governs", "this license governs use of the accompanying software if you use the software you accept this license"),
    ("ncsa", 5, 1.0, "illinois", "developed by (?:[^ ]+ ){1,8}university of illinois(?: at urbana champaign)?"),
    ("artistic-2", 5, 1.0, "everyone verbatim", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble this license establishes the terms under which a given free software package"),
    ("sspl-1", 5, 1.0, "server october", "server side public license version 1 october 16 2018"),
    ("curl", 5, 0.9, "daniel stenberg", "copyright c (?:[^ ]+ ){1,6}daniel stenberg (?:[^ ]+ ){1,20}all rights reserved permission to use copy modify"),
    ("postgresql", 5, 1.0, "agreement hereby", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("public-domain", 5, 0.8, "public domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("proprietary", 5, 0.8, "confidential proprietary", "(?:confidential and proprietary|proprietary and confidential)(?: information)?"),
    ("proprietary", 5, 0.7, "unauthorized copying", "unauthorized copying of this file via any medium is strictly prohibited"),
    # Grants that name a license.
    ("0bsd", 4, 0.95, "0bsd", _UNDER + "(?:0bsd|zero clause bsd|bsd zero clause)(?: " + _L + ")?"),
    ("afl-3", 4, 0.95, "academic free", _UNDER + "academic free " + _L + "(?:" + _V + "3(?: 0)?)?"),
    ("agpl-3", 4, 0.95, "affero public", _UNDER + "(?:gnu )?affero general public " + _L + "(?:" + _V + "3(?: 0)?)?"),
    ("agpl-3", 4, 0.95, "agpl", _UNDER + "(?:gnu )?agpl(?:" + _V + "3(?: 0)?)?(?: " + _L + ")?"),
    ("agpl-3", 4, 0.95, "agplv3", _UNDER + "(?:gnu )?agplv3(?: 0)?(?: " + _L + ")?"),
    ("apache-2", 4, 0.95, "apache", _UNDER + "apache(?: software)?(?: " + _L + ")?" + _V + "2(?: 0)?(?: " + _L + ")?"),
    ("apache-1", 4, 0.95, "apache", _UNDER + "apache(?: software)?(?: " + _L + ")?" + _V + "1 [01](?: " + _L + ")?"),
    ("apache-2", 4, 0.85, "apache", _UNDER + "apache(?: software)? " + _L),
    ("apsl-2", 4, 0.95, "apple source", _UNDER + "apple public source " + _L + "(?:" + _V + "2(?: 0)?)?"),
    ("artistic-1", 4, 0.95, "artistic", _UNDER + "artistic " + _L + _V + "1(?: 0)?"),
    ("artistic-2", 4, 0.95, "artistic", _UNDER + "artistic " + _L + "(?:" + _V + "2(?: 0)?)?"),
    ("blueoak-1", 4, 0.95, "blue oak", _UNDER + "blue oak model " + _L + "(?: 1 0 0)?"),
    ("bsd-2-clause", 4, 0.95, "bsd", _UNDER + "(?:simplified bsd|freebsd|(?:2|two) clause bsd|bsd (?:2|two) clause)(?: " + _L + ")?"),
    ("bsd-3-clause", 4, 0.95, "bsd", _UNDER + "(?:(?:new|modified|revised) bsd|(?:3|three) clause bsd|bsd (?:3|three) clause)(?: " + _L + ")?"),
    ("bsd-4-clause", 4, 0.95, "bsd", _UNDER + "(?:original bsd|(?:4|four) clause bsd|bsd (?:4|four) clause)(?: " + _L + ")?"),
    ("bsd", 4, 0.8, "bsd", _UNDER + "bsd(?: style| like)?(?: " + _L + ")?"),
    ("bsl-1", 4, 0.95, "boost", _UNDER + "boost(?: software)? " + _L + "(?:" + _V + "1(?: 0)?)?"),
    ("busl-1", 4, 0.95, "business source", _UNDER + "business source " + _L + "(?:" + _V + "1(?: 1)?)?"),
    ("cc0", 4, 0.95, "cc0", _UNDER + "cc0(?: 1 0)?(?: universal)?(?: " + _L + ")?"),
    ("cc0", 4, 0.95, "cc zero", _UNDER + "cc zero(?: 1 0)?(?: " + _L + ")?"),
    ("cc0", 4, 0.95, "commons zero", _UNDER + "creative commons zero(?: 1 0)?(?: " + _L + ")?"),
    ("cc-by-nc-sa", 4, 0.95, "cc", _UNDER + "(?:an? )?cc " + _BY + " " + _NC + " " + _SA + _CCV),
    ("cc-by-nc-sa", 4, 0.95, "creative commons", _UNDER + "(?:an? )?creative commons " + _BY + " " + _NC + " " + _SA + _CCV),
    ("cc-by-nc-nd", 4, 0.95, "cc", _UNDER + "(?:an? )?cc " + _BY + " " + _NC + " " + _ND + _CCV),
    ("cc-by-nc-nd", 4, 0.95, "creative commons", _UNDER + "(?:an? )?creative commons " + _BY + " " + _NC + " " + _ND + _CCV),
    ("cc-by-nc", 4, 0.95, "cc", _UNDER + "(?:an? )?cc " + _BY + " " + _NC + _CCV),
    ("cc-by-nc", 4, 0.95, "creative commons", _UNDER + "(?:an? )?creative commons " + _BY + " " + _NC + _CCV),
    ("cc-by-sa", 4, 0.95, "cc", _UNDER + "(?:an? )?cc " + _BY + " " + _SA + _CCV),
    ("cc-by-sa", 4, 0.95, "creative commons", _UNDER + "(?:an? )?creative commons " + _BY + " " + _SA + _CCV),
    ("cc-by-nd", 4, 0.95, "cc", _UNDER + "(?:an? )?cc " + _BY + " " + _ND + _CCV),
    ("cc-by-nd", 4, 0.95, "creative commons", _UNDER + "(?:an? )?creative commons " + _BY + " " + _ND + _CCV),
    ("cc-by", 4, 0.9, "cc", _UNDER + "(?:an? )?cc " + _BY + _CCV),
    ("cc-by", 4, 0.9, "creative commons", _UNDER + "(?:an? )?creative commons " + _BY + _CCV),
    ("cddl-1", 4, 0.95, "cddl", _UNDER + "cddl(?:" + _V + "1(?: [01])?)?(?: " + _L + ")?"),
    ("cecill-2", 4, 0.95, "cecill", _UNDER + "cecill(?: " + _L + ")?(?:" + _V + "2(?: [01])?)?"),
    ("cpl-1", 4, 0.95, "common public", _UNDER + "common public " + _L + "(?:" + _V + "1(?: 0)?)?"),
    ("epl-1", 4, 0.95, "eclipse public", _UNDER + "eclipse public " + _L + _V + "1(?: 0)?"),
    ("epl-2", 4, 0.95, "eclipse public", _UNDER + "eclipse public " + _L + "(?:" + _V + "2(?: 0)?)?"),
    ("eupl-1", 4, 0.95, "european union", _UNDER + "european union public " + _L + "(?:" + _V + "1(?: [012])?)?"),
    ("gfdl-1", 4, 0.95, "free documentation", _UNDER + "gnu free documentation " + _L + "(?:" + _V + "1(?: [123])?)?"),
    ("gpl-2", 4, 0.95, "general public", _UNDER + "(?:gnu )?general public " + _L + _V + "2(?: 0)?" + _LATER),
    ("gpl-3", 4, 0.95, "general public", _UNDER + "(?:gnu )?general public " + _L + _V + "3(?: 0)?" + _LATER),
    ("gpl-2", 4, 0.95, "gplv2", _UNDER + "(?:gnu )?gplv2" + _LATER),
    ("gpl-3", 4, 0.95, "gplv3", _UNDER + "(?:gnu )?gplv3" + _LATER),
    ("gpl-2", 4, 0.95, "gpl", _UNDER + "(?:gnu )?gpl" + _V + "2(?: 0)?" + _LATER),
    ("gpl-3", 4, 0.95, "gpl", _UNDER + "(?:gnu )?gpl" + _V + "3(?: 0)?" + _LATER),
    ("gpl", 4, 0.8, "gpl", _UNDER + "(?:gnu )?gpl(?: " + _L + ")?"),
    ("gpl", 4, 0.8, "general public", _UNDER + "(?:gnu )?general public " + _L),
    ("isc", 4, 0.95, "isc", _UNDER + "isc(?: " + _L + ")?"),
    ("lgpl-2", 4, 0.95, "lgpl", _UNDER + "(?:gnu )?lgpl" + _V + "2(?: [01])?" + _LATER),
    ("lgpl-3", 4, 0.95, "lgpl", _UNDER + "(?:gnu )?lgpl" + _V + "3(?: 0)?" + _LATER),
    ("lgpl-2", 4, 0.95, "general public", _UNDER + "(?:gnu )?(?:lesser|library) general public " + _L + _V + "2(?: [01])?" + _LATER),
    ("lgpl-3", 4, 0.95, "lesser public", _UNDER + "(?:gnu )?lesser general public " + _L + _V + "3(?: 0)?" + _LATER),
    ("lgpl", 4, 0.8, "lesser public", _UNDER + "(?:gnu )?lesser general public " + _L),
    ("lppl-1", 4, 0.95, "latex", _UNDER + "latex project public " + _L + "(?:" + _V + "1(?: 3c?)?)?"),
    ("mit", 4, 0.95, "mit under", _GRANTED + " under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?mit(?: expat| x11)?(?: style| open source)?(?: " + _L + ")?"),
    ("mit", 4, 0.9, "expat", _UNDER + "expat " + _L),
    ("mpl-1", 4, 0.95, "mozilla public", _UNDER + "mozilla public " + _L + _V + "1(?: [01])?"),
    ("mpl-2", 4, 0.95, "mozilla public", _UNDER + "mozilla public " + _L + "(?:" + _V + "2(?: 0)?)?"),
    ("ms-pl", 4, 0.95, "microsoft public", _UNDER + "microsoft public " + _L),
    ("ms-rl", 4, 0.95, "microsoft reciprocal", _UNDER + "microsoft reciprocal " + _L),
    ("ncsa", 4, 0.95, "illinois", _UNDER + "university of illinois(?: ncsa)? open source " + _L),
    ("odbl-1", 4, 0.95, "open database", _UNDER + "open (?:data commons open )?database " + _L + "(?: odbl)?"),
    ("ofl-1", 4, 0.95, "open font", _UNDER + "(?:sil )?open font " + _L + "(?:" + _V + "1(?: [01])?)?"),
    ("openssl", 4, 0.95, "openssl", _UNDER + "openssl " + _L),
    ("osl-3", 4, 0.95, "open software", _UNDER + "open software " + _L + "(?:" + _V + "3(?: 0)?)?"),
    ("php-3", 4, 0.95, "php", _UNDER + "php " + _L + "(?:" + _V + "3(?: 01?)?)?"),
    ("psf-2", 4, 0.95, "python under", _GRANTED + " under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?python(?: software foundation)? " + _L + "(?:" + _V + "2(?: 0)?)?"),
    ("sspl-1", 4, 0.95, "server side", _UNDER + "server side public " + _L + "(?:" + _V + "1)?"),
    ("unlicense", 4, 0.95, "unlicense", _UNDER + "unlicense"),
    ("upl-1", 4, 0.95, "universal permissive", _UNDER + "universal permissive " + _L + "(?:" + _V + "1(?: 0)?)?"),
    ("wtfpl", 4, 0.95, "wtfpl", _UNDER + "wtfpl(?: " + _L + ")?"),
    ("zlib", 4, 0.95, "zlib", _UNDER + "zlib(?: libpng)?(?: " + _L + ")?"),
    ("zpl-2", 4, 0.95, "zope", _UNDER + "zope public " + _L + "(?:" + _V + "2(?: [01])?)?"),
    ("proprietary", 4, 0.7, "commercial under", _GRANTED + " under (?:an? |the )?commercial " + _L),
    ("proprietary", 4, 0.7, "proprietary under", _GRANTED + " under (?:an? |the )?proprietary " + _L),
    # Fields: "license: x", "license type x".
    ("apache-2", 3, 0.85, "apache", _L + "(?: (?:type|name|is))? apache(?: software)?(?: " + _L + ")?" + _V + "2(?: 0)?"),
    ("bsd-2-clause", 3, 0.85, "bsd", _L + "(?: (?:type|name|is))? bsd (?:2|two) clause"),
    ("bsd-3-clause", 3, 0.85, "bsd", _L + "(?: (?:type|name|is))? bsd (?:3|three) clause"),
    ("bsd", 3, 0.75, "bsd", _L + "(?: (?:type|name|is))? bsd"),
    ("cc-by-nc", 3, 0.85, "cc nc", _L + "(?: (?:type|name|is))? cc by nc(?: [1234] [05])?"),
    ("cc-by-sa", 3, 0.85, "cc sa", _L + "(?: (?:type|name|is))? cc by sa(?: [1234] [05])?"),
    ("cc-by", 3, 0.85, "cc by", _L + "(?: (?:type|name|is))? cc by(?: [1234] [05])?"),
    ("cc0", 3, 0.85, "cc0", _L + "(?: (?:type|name|is))? cc0(?: 1 0)?"),
    ("gpl-2", 3, 0.85, "gpl", _L + "(?: (?:type|name|is))? gpl" + _V + "2(?: 0)?" + _LATER),
    ("gpl-3", 3, 0.85, "gpl", _L + "(?: (?:type|name|is))? gpl" + _V + "3(?: 0)?" + _LATER),
    ("isc", 3, 0.85, "isc", _L + "(?: (?:type|name|is))? isc"),
    ("lgpl-2", 3, 0.85, "lgpl", _L + "(?: (?:type|name|is))? lgpl" + _V + "2(?: [01])?" + _LATER),
    ("lgpl-3", 3, 0.85, "lgpl", _L + "(?: (?:type|name|is))? lgpl" + _V + "3(?: 0)?" + _LATER),
    ("mit", 3, 0.85, "license mit", "license(?: (?:type|name|is))? mit"),
    ("mpl-2", 3, 0.85, "mpl", _L + "(?: (?:type|name|is))? mpl" + _V + "2(?: 0)?"),
    ("proprietary", 3, 0.7, "proprietary", _L + "(?: (?:type|name|is))? (?:proprietary|commercial|all rights reserved)"),
    # Names with their version.
    ("afl-3", 3, 0.8, "academic free", "academic free " + _L + "(?:" + _V + "3(?: 0)?)?"),
    ("agpl-3", 3, 0.8, "affero public", "(?:gnu )?affero general public " + _L + "(?:" + _V + "3(?: 0)?)?"),
    ("apache-1", 3, 0.8, "apache", "apache(?: software)? " + _L + _V + "1 [01]"),
    ("apache-2", 3, 0.8, "apache", "apache(?: software)? " + _L + _V + "2(?: 0)?"),
    ("artistic-2", 3, 0.8, "artistic", "artistic " + _L + _V + "2(?: 0)?"),
    ("bsl-1", 3, 0.8, "boost", "boost software " + _L + "(?:" + _V + "1(?: 0)?)?"),
    ("busl-1", 3, 0.8, "business source", "business source " + _L + "(?:" + _V + "1(?: 1)?)?"),
    ("cc-by-nc-sa", 3, 0.8, "creative commons", "creative commons " + _BY + " " + _NC + " " + _SA + _CCV),
    ("cc-by-nc-nd", 3, 0.8, "creative commons", "creative commons " + _BY + " " + _NC + " " + _ND + _CCV),
    ("cc-by-nc", 3, 0.8, "creative commons", "creative commons " + _BY + " " + _NC + _CCV),
    ("cc-by-sa", 3, 0.8, "creative commons", "creative commons " + _BY + " " + _SA + _CCV),
    ("cc-by-nd", 3, 0.8, "creative commons", "creative commons " + _BY + " " + _ND + _CCV),
    ("cc-by", 3, 0.8, "creative commons", "creative commons " + _BY + _CCV),
    ("cddl-1", 3, 0.8, "common development", "common development and distribution " + _L + "(?:" + _V + "1(?: [01])?)?"),
    ("cpl-1", 3, 0.8, "common public", "common public " + _L + "(?:" + _V + "1(?: 0)?)?"),
    ("epl-1", 3, 0.8, "eclipse public", "eclipse public " + _L + _V + "1(?: 0)?"),
    ("epl-2", 3, 0.8, "eclipse public", "eclipse public " + _L + _V + "2(?: 0)?"),
    ("eupl-1", 3, 0.8, "european union", "european union public " + _L + "(?:" + _V + "1(?: [012])?)?"),
    ("gfdl-1", 3, 0.8, "free documentation", "(?:gnu )?free documentation " + _L + "(?:" + _V + "1(?: [123])?)?"),
    ("gpl-2", 3, 0.8, "general public", "(?:gnu )?general public " + _L + _V + "2(?: 0)?" + _LATER),
    ("gpl-3", 3, 0.8, "general public", "(?:gnu )?general public " + _L + _V + "3(?: 0)?" + _LATER),
    ("lgpl-2", 3, 0.8, "general public", "(?:gnu )?(?:lesser|library) general public " + _L + _V + "2(?: [01])?" + _LATER),
    ("lgpl-3", 3, 0.8, "lesser public", "(?:gnu )?lesser general public " + _L + _V + "3(?: 0)?" + _LATER),
    ("lppl-1", 3, 0.8, "latex", "latex project public " + _L + "(?:" + _V + "1(?: 3c?)?)?"),
    ("mpl-1", 3, 0.8, "mozilla public", "mozilla public " + _L + _V + "1(?: [01])?"),
    ("mpl-2", 3, 0.8, "mozilla public", "mozilla public " + _L + _V + "2(?: 0)?"),
    ("ms-pl", 3, 0.8, "microsoft public", "microsoft public " + _L),
    ("ms-rl", 3, 0.8, "microsoft reciprocal", "microsoft reciprocal " + _L),
    ("odbl-1", 3, 0.8, "open database", "open (?:data commons open )?database " + _L),
    ("ofl-1", 3, 0.8, "open font", "(?:sil )?open font " + _L + "(?:" + _V + "1(?: [01])?)?"),
    ("psf-2", 3, 0.8, "python foundation", "python software foundation " + _L + "(?:" + _V + "2(?: 0)?)?"),
    ("sspl-1", 3, 0.8, "server side", "server side public " + _L + "(?:" + _V + "1)?"),
    ("upl-1", 3, 0.8, "universal permissive", "universal permissive " + _L + "(?:" + _V + "1(?: 0)?)?"),
    ("zpl-2", 3, 0.8, "zope", "zope public " + _L + "(?:" + _V + "2(?: [01])?)?"),
    # Short identifiers.
    ("0bsd", 2, 0.6, "0bsd", "0bsd"),
    ("agpl-3", 2, 0.6, "agpl", "agpl" + _V + "3(?: 0)?" + _LATER),
    ("agpl-3", 2, 0.6, "agplv3", "agplv3" + _LATER),
    ("apache-2", 2, 0.6, "apache", "apache 2 0"),
    ("bsd-2-clause", 2, 0.6, "bsd", "(?:bsd (?:2|two) clause|(?:2|two) clause bsd)"),
    ("bsd-3-clause", 2, 0.6, "bsd", "(?:bsd (?:3|three) clause|(?:3|three) clause bsd)"),
    ("bsl-1", 2, 0.5, "bsl", "bsl 1 0"),
    ("cc0", 2, 0.6, "cc0", "cc0(?: 1 0)?"),
    ("cc-by-nc-sa", 2, 0.6, "cc nc", "cc by nc sa(?: [1234] [05])?"),
    ("cc-by-nc-nd", 2, 0.6, "cc nc", "cc by nc nd(?: [1234] [05])?"),
    ("cc-by-nc", 2, 0.6, "cc nc", "cc by nc(?: [1234] [05])?"),
    ("cc-by-sa", 2, 0.6, "cc sa", "cc by sa(?: [1234] [05])?"),
    ("cc-by-nd", 2, 0.6, "cc nd", "cc by nd(?: [1234] [05])?"),
    ("cc-by", 2, 0.6, "cc by", "cc by [1234] [05]"),
    ("cddl-1", 2, 0.6, "cddl", "cddl(?: 1 [01])?"),
    ("epl-1", 2, 0.6, "epl", "epl 1 0"),
    ("epl-2", 2, 0.6, "epl", "epl 2 0"),
    ("gpl-2", 2, 0.6, "gpl", "(?:gnu )?gpl" + _V + "2(?: 0)?" + _LATER),
    ("gpl-3", 2, 0.6, "gpl", "(?:gnu )?gpl" + _V + "3(?: 0)?" + _LATER),
    ("gpl-2", 2, 0.6, "gplv2", "gplv2" + _LATER),
    ("gpl-3", 2, 0.6, "gplv3", "gplv3" + _LATER),
    ("lgpl-2", 2, 0.6, "lgpl", "lgpl" + _V + "2(?: [01])?" + _LATER),
    ("lgpl-3", 2, 0.6, "lgpl", "lgpl" + _V + "3(?: 0)?" + _LATER),
    ("mpl-2", 2, 0.6, "mpl", "mpl" + _V + "2(?: 0)?"),
    ("odbl-1", 2, 0.5, "odbl", "odbl(?: 1 0)?"),
    ("ofl-1", 2, 0.5, "ofl", "ofl 1 [01]"),
    ("unlicense", 2, 0.6, "unlicense", "(?:the )?unlicense"),
    ("wtfpl", 2, 0.6, "wtfpl", "wtfpl"),
    # Names in passing.
    ("apache-2", 1, 0.5, "apache", "apache(?: software)? " + _L),
    ("artistic-1", 1, 0.5, "artistic", "artistic " + _L),
    ("beerware", 1, 0.5, "beerware", "beerware(?: " + _L + ")?"),
    ("bsd", 1, 0.4, "bsd", "bsd(?: style| like)? " + _L),
    ("cc", 1, 0.4, "creative commons", "creative commons(?: " + _L + ")?"),
    ("epl-2", 1, 0.4, "eclipse public", "eclipse public " + _L),
    ("gpl", 1, 0.4, "general public", "(?:gnu )?general public " + _L),
    ("gpl", 1, 0.4, "gpl", "(?:gnu )?gpl(?: " + _L + ")?"),
    ("isc", 1, 0.4, "isc", "isc(?: " + _L + ")?"),
    ("lgpl", 1, 0.4, "lgpl", "lgpl(?: " + _L + ")?"),
    ("mit", 1, 0.6, "mit license", "(?:the )?mit(?: expat| x11)? license"),
    ("mit", 1, 0.6, "mit licence", "(?:the )?mit(?: expat| x11)? licence"),
    ("mpl-2", 1, 0.4, "mozilla public", "mozilla public " + _L),
    ("openssl", 1, 0.4, "openssl", "openssl " + _L),
    ("php-3", 1, 0.4, "php", "php " + _L),
    ("zlib", 1, 0.4, "zlib", "zlib(?: libpng)? " + _L),
)
LEVELS = 5


def words_line(text: Column) -> Column:
    """The words with one space around each; a single space where there is none."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    flat = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), upper, lower), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    return F.concat(F.lit(" "), F.trim(flat), F.when(F.trim(flat) == "", F.lit("")).otherwise(F.lit(" ")))


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def _base(line: Column, phrase: str) -> Column:
    """Places of a phrase: how many, and words before the first and after the last."""
    parts = F.split(line, f" {phrase}(?= )", -1)
    found = F.struct(
        (F.size(parts) - 1).cast("long").alias("places"),
        _spaces(F.get(parts, F.lit(0))).cast("long").alias("before"),
        (_spaces(F.element_at(parts, -1)) - 1).cast("long").alias("after"),
    )
    return F.when(F.contains(line, F.lit(f" {phrase} ")), found)


def keywords() -> list[str]:
    return sorted({k for _, _, _, keys, _ in SIGNATURES for k in keys.split()})


def _detections(line: Column, found: Column) -> Column:
    """Spans of all signatures that the keywords ``found`` leave: array of start, minus end, number, priority, label, confidence; in this order."""
    table = F.array(
        *[
            # Ends before a space, which the next match may begin with.
            F.struct(F.lit(i).alias("i"), F.array(*map(F.lit, keys.split())).alias("k"), F.lit(label).alias("label"), F.lit(p).alias("p"), F.lit(c).alias("c"), F.lit(f" {x}(?= )").alias("x"))
            for i, (label, p, c, keys, x) in enumerate(SIGNATURES)
        ]
    )
    fitting = F.filter(table, lambda r: F.forall(r.k, lambda k: F.array_contains(found, k)))

    def spans(r: Column) -> Column:
        texts = F.regexp_extract_all(line, r.x, F.lit(0))
        between = F.split(line, r.x, -1)
        start = F.struct(F.lit(0).cast("int").alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("all"))

        def step(acc: Column, pair: Column) -> Column:
            begin = acc["at"] + F.length(pair["b"])
            end = begin + F.length(pair["t"])
            return F.struct(end.alias("at"), F.concat(acc["all"], F.array(F.struct(begin.alias("start"), end.alias("end")))).alias("all"))

        pairs = F.zip_with(texts, F.slice(between, F.lit(1), F.size(texts)), lambda t, b: F.struct(t.alias("t"), b.alias("b")))
        places = F.aggregate(pairs, start, step, lambda acc: acc["all"])
        return F.transform(places, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), r.i.alias("i"), r.p.alias("p"), r.label.alias("label"), r.c.alias("c")))

    return F.array_sort(F.flatten(F.transform(fitting, spans)))


def _kept(spans: Column) -> Column:
    """Labels and best confidence left after suppression: one sweep from the end, one from the start.

    The first marks what a detection of higher priority overlaps that begins
    later: it remembers the nearest start at each priority.  The second drops
    these, what a detection of higher priority overlaps that begins no later,
    and what one of its own priority contains: it remembers the furthest end at
    each priority.
    """
    kind = "array<struct<start:int,end:int,p:int,label:string,c:double,beaten:boolean>>"
    none = F.array(*[F.lit(1 << 30)] * LEVELS)

    def back(acc: Column, s: Column) -> Column:
        beaten = F.exists(F.slice(acc["near"], s["p"] + 1, F.lit(LEVELS)), lambda x: x < -s["end"])
        seen = F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["p"].alias("p"), s["label"].alias("label"), s["c"].alias("c"), beaten.alias("beaten"))
        near = F.transform(acc["near"], lambda x, i: F.when(i + 1 == s["p"], s["start"]).otherwise(x))
        return F.struct(near.alias("near"), F.concat(acc["all"], F.array(seen)).cast(kind).alias("all"))

    marked = F.aggregate(F.reverse(spans), F.struct(none.alias("near"), F.array().cast(kind).alias("all")), back, lambda acc: F.reverse(acc["all"]))
    start = F.struct(F.array(*[F.lit(-1)] * LEVELS).alias("far"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("best"))

    def step(acc: Column, s: Column) -> Column:
        higher = F.exists(F.slice(acc["far"], s["p"] + 1, F.lit(LEVELS)), lambda x: x > s["start"])
        inside = F.get(acc["far"], s["p"] - 1) >= s["end"]
        far = F.transform(acc["far"], lambda x, i: F.when(i + 1 == s["p"], F.greatest(x, s["end"])).otherwise(x))
        goes = s["beaten"] | higher | inside
        return F.struct(
            far.alias("far"),
            F.when(goes, acc["labels"]).otherwise(F.array_union(acc["labels"], F.array(s["label"]))).alias("labels"),
            F.when(goes, acc["best"]).otherwise(F.greatest(acc["best"], s["c"])).alias("best"),
        )

    return F.aggregate(marked, start, step, lambda acc: F.struct(acc["labels"].alias("labels"), acc["best"].alias("best")))


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, n_words, n_base, first_word, last_word, base_labels, labels, score`` for each row.

    One narrow stage of built-in functions: nothing is shuffled, and texts
    without any keyword end at one look-up of their words.
    """
    line = F.col("line")
    lined = docs.select(F.col(key).alias("doc_id"), words_line(F.col(text)).alias("line"))
    lined = lined.withColumn("n_words", F.when(line == " ", F.lit(0)).otherwise(_spaces(line) - 1).cast("long"))
    lined = lined.withColumn("keys", F.array_intersect(F.split(line, " "), F.array(*map(F.lit, keywords()))))
    for i, (phrase, _) in enumerate(BASE):
        lined = lined.withColumn(f"b{i}", _base(line, phrase))
    nothing = F.struct(F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("best"))
    lined = lined.withColumn("spans", F.when(F.size("keys") > 0, _detections(line, F.col("keys"))))
    lined = lined.withColumn("found", F.when(F.size("spans") > 0, _kept(F.col("spans"))).otherwise(nothing))
    b = [F.col(f"b{i}") for i in range(len(BASE))]
    first = F.array_min(F.array(*[x["before"] for x in b]))
    last = F.array_max(F.array(*[F.col("n_words") - x["after"] - len(p.split()) for x, (p, _) in zip(b, BASE, strict=True)]))
    base = F.array_sort(F.array_compact(F.array(*[F.when(x.isNotNull(), F.lit(label)) for x, (_, label) in zip(b, BASE, strict=True)])))
    places = sum((F.coalesce(x["places"], F.lit(0)) for x in b), F.lit(0)).cast("long")
    return lined.select(
        F.col("doc_id").alias(key),
        "n_words",
        places.alias("n_base"),
        first.alias("first_word"),
        last.alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.col("found.labels"))), ",").alias("labels"),
        F.greatest(F.col("found.best"), F.when(places > 0, F.lit(0.9)).otherwise(F.lit(0.0))).alias("score"),
    )
