"""License scan: ordered signature rules behind a keyword prefilter, with containment suppression.

A text is lower-cased (A-Z only) and every rule whose keywords, words its regex can't match without, all occur in it runs its regex over the whole text. Detections
are taken by priority, then length, then place; one that lies inside a kept detection is suppressed. Base phrases are found
apart from the rules and always stay.

Null or empty text: no words, no labels, score 0. Each row stands alone, so ties and repeated rows come out alike.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as sre_parse
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipehat.llm.arrow import map_batches, slices

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
#: For bytes of UTF-8: those of words stay, all others become spaces.
WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isascii() and chr(b).isalnum() else 32 for b in range(256))
BASE = {"mit": ("mit", "license"), "apache": ("apache", "license"), "gpl": ("general", "public", "license")}

# Signature rules, one to a line: label | priority | hint | regex; keywords come from the regex. A space in a regex stands for any run of non-word
# characters. Priorities: 90 identifier tags and urls, 80 full texts, 70 full names with a version, 60 full names, 50 notices
# and short names, 30 hints.
RULES_TEXT = r"""
mit | 80 | permission is hereby granted, sublicense | permission is hereby granted free of charge to any person obtaining a copy
mit | 90 | opensource.org | opensource\.org/licenses?/mit\b(?!-)
mit | 60 | mit license | (?:the )?mit licen[sc]e
mit | 60 | mit/x11 | mit/x11(?: licen[sc]e)?
mit | 60 | expat | expat licen[sc]e
mit | 70 | released under | released under the mit licen[sc]e
mit | 70 | licensed under | licensed under the mit licen[sc]e
mit | 70 | distributed under | distributed under the mit licen[sc]e
mit | 70 | terms of the mit | terms of the mit licen[sc]e
mit-0 | 75 | mit no attribution | mit no attribution
mit-0 | 90 | mit-0 | spdx licen[sc]e identifier mit-0\b
mit | 90 | spdx | spdx licen[sc]e identifier mit\b(?!-)
apache-2.0 | 80 | apache license | apache licen[sc]e version 2\.0
apache-2.0 | 70 | apache | apache(?: software)? licen[sc]e v?2(?:\.0)?
apache-2.0 | 70 | apache-2 | apache-2(?:\.0)?\b
apache-2.0 | 90 | apache.org | apache\.org/licenses/license-2\.0
apache-2.0 | 90 | spdx | spdx licen[sc]e identifier apache-2\.0
apache-2.0 | 85 | apache license | licensed under the apache licen[sc]e version 2\.0(?: the license)?
apache-2.0 | 80 | without warranties or conditions of any kind | as is basis without warranties or conditions of any kind
apache-1.1 | 70 | apache | apache(?: software)? licen[sc]e (?:version )?1\.1
apache-1.1 | 90 | spdx | spdx licen[sc]e identifier apache-1\.1
apache-1.0 | 70 | apache | apache(?: software)? licen[sc]e (?:version )?1\.0
apache-1.0 | 90 | spdx | spdx licen[sc]e identifier apache-1\.0
apache | 60 | apache license | apache licen[sc]e
apache | 50 | apache software license | apache software licen[sc]e
gpl-3.0 | 85 | general public license | (?:gnu )?general public licen[sc]e(?: as published by the free software foundation)? (?:either )?(?:version|v) ?3(?:\.0)?
gpl-3.0 | 70 | gpl | gnu gpl ?v?3(?:\.0)?\b
gpl-3.0 | 70 | gplv3 | gplv3(?:\+| or later)?
gpl-3.0 | 70 | gpl-3 | \bgpl-3(?:\.0)?(?:-only|-or-later|\+)?\b
gpl-3.0 | 90 | spdx | spdx licen[sc]e identifier gpl-3\.0
gpl-2.0 | 85 | general public license | (?:gnu )?general public licen[sc]e(?: as published by the free software foundation)? (?:either )?(?:version|v) ?2(?:\.0)?
gpl-2.0 | 70 | gpl | gnu gpl ?v?2(?:\.0)?\b
gpl-2.0 | 70 | gplv2 | gplv2(?:\+| or later)?
gpl-2.0 | 70 | gpl-2 | \bgpl-2(?:\.0)?(?:-only|-or-later|\+)?\b
gpl-2.0 | 90 | spdx | spdx licen[sc]e identifier gpl-2\.0
gpl-1.0 | 85 | general public license | (?:gnu )?general public licen[sc]e (?:either )?(?:version|v) ?1(?:\.0)?\b
gpl-1.0 | 90 | spdx | spdx licen[sc]e identifier gpl-1\.0
gpl | 60 | general public license | (?:gnu )?general public licen[sc]e
gpl | 50 | gnu gpl | gnu gpl\b
gpl | 80 | free software foundation | you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e
gpl | 90 | gnu.org | gnu\.org/licenses/(?:old-licenses/)?gpl
gpl-classpath | 95 | classpath exception | classpath exception
gpl-linking | 75 | linking exception | (?:gcc|gpl) linking exception
lgpl-3.0 | 95 | lesser general public license | (?:gnu )?lesser general public licen[sc]e (?:either )?(?:version|v) ?3(?:\.0)?
lgpl-3.0 | 75 | lgpl | \blgpl ?-?v?3(?:\.0)?
lgpl-3.0 | 90 | spdx | spdx licen[sc]e identifier lgpl-3\.0
lgpl-2.1 | 95 | lesser general public license | (?:gnu )?lesser general public licen[sc]e (?:either )?(?:version|v) ?2\.1
lgpl-2.1 | 75 | lgpl | \blgpl ?-?v?2\.1
lgpl-2.1 | 90 | spdx | spdx licen[sc]e identifier lgpl-2\.1
lgpl-2.0 | 95 | library general public license | (?:gnu )?library general public licen[sc]e(?: version 2(?:\.0)?)?
lgpl-2.0 | 75 | lgpl | \blgpl ?-?v?2(?:\.0)\b
lgpl-2.0 | 90 | spdx | spdx licen[sc]e identifier lgpl-2\.0
lgpl | 92 | lesser general public license | (?:gnu )?lesser general public licen[sc]e
lgpl | 50 | gnu lgpl | gnu lgpl\b
lgpl | 90 | gnu.org | gnu\.org/licenses/lgpl
agpl-3.0 | 95 | affero general public license | (?:gnu )?affero general public licen[sc]e (?:either )?(?:version|v) ?3(?:\.0)?
agpl-3.0 | 75 | agpl | \bagpl ?-?v?3(?:\.0)?
agpl-3.0 | 90 | spdx | spdx licen[sc]e identifier agpl-3\.0
agpl-1.0 | 95 | affero general public license | affero general public licen[sc]e (?:version|v) ?1(?:\.0)?
agpl | 92 | affero general public license | (?:gnu )?affero general public licen[sc]e
agpl | 90 | gnu.org | gnu\.org/licenses/agpl
gfdl-1.3 | 85 | free documentation license | (?:gnu )?free documentation licen[sc]e version 1\.3
gfdl-1.2 | 85 | free documentation license | (?:gnu )?free documentation licen[sc]e version 1\.2
gfdl-1.1 | 85 | free documentation license | (?:gnu )?free documentation licen[sc]e version 1\.1
gfdl | 60 | free documentation license | (?:gnu )?free documentation licen[sc]e
gfdl | 90 | spdx | spdx licen[sc]e identifier gfdl-1\.[123]
bsd-3-clause | 80 | neither the name | neither the name of [^.]{1,120} may be used to endorse or promote products
bsd-3-clause | 75 | bsd | bsd 3 clause(?: licen[sc]e)?
bsd-3-clause | 75 | bsd | (?:new|revised|modified|three clause|3 clause) bsd licen[sc]e
bsd-3-clause | 90 | opensource.org | opensource\.org/licenses?/bsd-3-clause
bsd-3-clause | 90 | spdx | spdx licen[sc]e identifier bsd-3-clause\b(?!-)
bsd-2-clause | 75 | bsd | bsd 2 clause(?: licen[sc]e)?
bsd-2-clause | 75 | bsd | (?:simplified|freebsd|two clause|2 clause) bsd licen[sc]e
bsd-2-clause | 90 | opensource.org | opensource\.org/licenses?/bsd-2-clause
bsd-2-clause | 90 | spdx | spdx licen[sc]e identifier bsd-2-clause\b(?!-)
bsd-2-clause-patent | 92 | bsd | bsd-2-clause-patent|bsd plus patent
bsd-4-clause | 80 | all advertising materials | all advertising materials mentioning features or use of this software
bsd-4-clause | 75 | bsd | (?:original|old|four clause|4 clause) bsd licen[sc]e
bsd-4-clause | 90 | spdx | spdx licen[sc]e identifier bsd-4-clause
bsd-1-clause | 90 | bsd-1 | bsd-1-clause
bsd-3-clause-clear | 92 | clear bsd | clear bsd licen[sc]e
0bsd | 90 | 0bsd | \b0bsd\b
0bsd | 75 | zero clause bsd | zero clause bsd
bsd | 60 | bsd | bsd(?: style)? licen[sc]e
bsd | 80 | redistribution and use in source | redistribution and use in source and binary forms with or without modification are permitted
bsd | 50 | berkeley | berkeley software distribution licen[sc]e
isc | 80 | permission to use, copy, modify | permission to use copy modify and or distribute this software for any purpose with or without fee
isc | 60 | isc license | \bisc licen[sc]e
isc | 90 | spdx | spdx licen[sc]e identifier isc\b
isc | 70 | internet systems consortium | internet systems consortium licen[sc]e
mpl-2.0 | 80 | mozilla public license | mozilla public licen[sc]e (?:version |v ?)?2\.0
mpl-2.0 | 90 | mozilla.org | mozilla\.org/mpl/2\.0
mpl-2.0 | 70 | mpl | \bmpl ?-?v?2\.0
mpl-2.0 | 90 | spdx | spdx licen[sc]e identifier mpl-2\.0
mpl-1.1 | 80 | mozilla public license | mozilla public licen[sc]e (?:version |v ?)?1\.1
mpl-1.1 | 90 | spdx | spdx licen[sc]e identifier mpl-1\.1
mpl-1.0 | 80 | mozilla public license | mozilla public licen[sc]e (?:version |v ?)?1\.0
mpl-1.0 | 90 | spdx | spdx licen[sc]e identifier mpl-1\.0
mpl | 60 | mozilla public license | mozilla public licen[sc]e
npl-1.1 | 75 | netscape public license | netscape public licen[sc]e(?: version 1\.[01])?
epl-2.0 | 80 | eclipse public license | eclipse public licen[sc]e (?:version |v ?)?2\.0
epl-2.0 | 90 | spdx | spdx licen[sc]e identifier epl-2\.0
epl-1.0 | 80 | eclipse public license | eclipse public licen[sc]e (?:version |v ?)?1\.0
epl-1.0 | 90 | spdx | spdx licen[sc]e identifier epl-1\.0
epl | 60 | eclipse public license | eclipse public licen[sc]e
epl | 90 | eclipse.org | eclipse\.org/legal/epl
edl-1.0 | 75 | eclipse distribution license | eclipse distribution licen[sc]e(?: v ?1\.0)?
cddl-1.1 | 80 | common development and distribution | common development and distribution licen[sc]e (?:version )?1\.1
cddl-1.0 | 80 | common development and distribution | common development and distribution licen[sc]e (?:version )?1\.0
cddl | 60 | common development and distribution | common development and distribution licen[sc]e
cddl-1.0 | 90 | cddl | \bcddl ?-?1\.0
cddl-1.1 | 90 | cddl | \bcddl ?-?1\.1
cpl-1.0 | 75 | common public license | common public licen[sc]e(?: version 1\.0)?
cpal-1.0 | 75 | common public attribution | common public attribution licen[sc]e(?: version 1\.0)?
ipl-1.0 | 75 | ibm public license | ibm public licen[sc]e(?: version 1\.0)?
apsl-2.0 | 75 | apple public source | apple public source licen[sc]e(?: version)? 2\.0
apsl-1.2 | 75 | apple public source | apple public source licen[sc]e(?: version)? 1\.2
apsl | 60 | apple public source | apple public source licen[sc]e
eupl-1.2 | 75 | european union public | european union public licen[sc]e v ?\.? ?1\.2
eupl-1.1 | 75 | european union public | european union public licen[sc]e v ?\.? ?1\.1
eupl-1.2 | 90 | eupl-1.2 | \beupl-1\.2
eupl-1.1 | 90 | eupl-1.1 | \beupl-1\.1
eupl | 60 | european union public | european union public licen[sc]e
osl-3.0 | 75 | open software license | open software licen[sc]e (?:version |v ?)?3\.0
osl-2.1 | 75 | open software license | open software licen[sc]e (?:version |v ?)?2\.1
osl | 60 | open software license | open software licen[sc]e
afl-3.0 | 75 | academic free license | academic free licen[sc]e (?:version |v ?)?3\.0
afl-2.1 | 75 | academic free license | academic free licen[sc]e (?:version |v ?)?2\.1
afl | 60 | academic free license | academic free licen[sc]e
artistic-2.0 | 75 | artistic license | artistic licen[sc]e (?:version |v ?)?2\.0
artistic-1.0 | 75 | artistic license | artistic licen[sc]e (?:version |v ?)?1\.0
artistic | 60 | artistic license | (?:perl )?artistic licen[sc]e
artistic-2.0 | 90 | spdx | spdx licen[sc]e identifier artistic-2\.0
perl | 75 | same terms as perl | same terms as perl itself
unlicense | 80 | free and unencumbered | this is free and unencumbered software released into the public domain
unlicense | 70 | unlicense | \b(?:the )?unlicen[sc]e\b
unlicense | 90 | unlicense.org | unlicense\.org
wtfpl | 70 | wtfpl | \bwtfpl\b
wtfpl | 75 | what the fuck you want | do what the fuck you want to public licen[sc]e
zlib | 75 | zlib | zlib(?: libpng)? licen[sc]e
zlib | 80 | altered source versions | altered source versions must be plainly marked as such
zlib | 90 | spdx | spdx licen[sc]e identifier zlib
libpng | 75 | libpng | libpng licen[sc]e(?: version 2)?
boost-1.0 | 80 | boost software license | boost software licen[sc]e version 1\.0
boost-1.0 | 70 | boost | \bbsl-1\.0|boost licen[sc]e
boost-1.0 | 60 | boost software license | boost software licen[sc]e
boost-1.0 | 90 | boost.org | boost\.org/license_1_0
bsl-1.1 | 75 | business source license | business source licen[sc]e(?: version)? 1\.1
bsl | 60 | business source license | business source licen[sc]e
sspl-1.0 | 75 | server side public license | server side public licen[sc]e(?: version| v)? ?1
sspl-1.0 | 90 | sspl | \bsspl-1\.0
elastic-2.0 | 75 | elastic license | elastic licen[sc]e (?:version )?2\.0
elastic | 60 | elastic license | elastic licen[sc]e
commons-clause | 75 | commons clause | commons clause(?: licen[sc]e)? condition
polyform-noncommercial | 75 | polyform noncommercial | polyform noncommercial licen[sc]e
polyform-strict | 75 | polyform strict | polyform strict licen[sc]e
polyform-shield | 75 | polyform shield | polyform shield licen[sc]e
confluent-community | 75 | confluent community | confluent community licen[sc]e
parity-7.0 | 75 | parity public license | parity public licen[sc]e
python-2.0 | 75 | python software foundation | python software foundation licen[sc]e(?: version 2)?
python-2.0 | 60 | psf license | psf licen[sc]e
python-cnri | 75 | cnri | cnri(?: open source)? licen[sc]e
php-3.01 | 75 | php license | php licen[sc]e version 3\.01
php-3.0 | 75 | php license | php licen[sc]e version 3\.0\b
php | 60 | php license | php licen[sc]e
zend-2.0 | 75 | zend | zend(?: engine)? licen[sc]e(?: version 2\.00)?
ruby | 60 | ruby license | ruby licen[sc]e
ruby | 75 | same terms as ruby | same terms as ruby itself
w3c | 75 | w3c | w3c software(?: notice)?(?: and)?(?: document)? licen[sc]e
openssl | 75 | openssl | openssl licen[sc]e
openssl | 85 | openssl | developed by the openssl project
ssleay | 75 | ssleay | ssleay licen[sc]e
curl | 75 | curl license | curl licen[sc]e
icu | 75 | icu license | icu licen[sc]e
unicode-dfs | 75 | unicode | unicode(?: inc)? licen[sc]e agreement
x11 | 75 | x11 license | (?<!/)x11 licen[sc]e
xfree86 | 75 | xfree86 | xfree86 licen[sc]e
ntp | 75 | ntp license | ntp licen[sc]e
hpnd | 75 | historical permission notice | historical permission notice and disclaimer
ncsa | 75 | ncsa | (?:university of illinois )?ncsa open source licen[sc]e
postgresql | 75 | postgresql license | postgresql licen[sc]e
sleepycat | 75 | sleepycat | sleepycat licen[sc]e
vim | 75 | vim license | vim licen[sc]e
tcl | 75 | tcl | tcl tk licen[sc]e
beerware | 75 | beer-ware | beer-ware licen[sc]e
beerware | 75 | beerware | beerware licen[sc]e
json | 80 | shall be used for good | software shall be used for good not evil
json | 60 | json license | json licen[sc]e
ms-pl | 75 | microsoft public license | microsoft public licen[sc]e
ms-pl | 60 | ms-pl | \bms-pl\b
ms-rl | 75 | microsoft reciprocal license | microsoft reciprocal licen[sc]e
ms-rl | 60 | ms-rl | \bms-rl\b
qpl-1.0 | 75 | q public license | q public licen[sc]e(?: version 1\.0)?
rpl-1.5 | 75 | reciprocal public license | reciprocal public licen[sc]e(?: 1\.5)?
nasa-1.3 | 75 | nasa open source | nasa open source agreement(?: version 1\.3)?
lppl-1.3c | 75 | latex project public | latex project public licen[sc]e(?: version)? 1\.3c?
lppl | 60 | latex project public | latex project public licen[sc]e
ofl-1.1 | 80 | open font license | (?:sil )?open font licen[sc]e version 1\.1
ofl | 60 | open font license | (?:sil )?open font licen[sc]e
ofl-1.1 | 90 | scripts.sil.org | scripts\.sil\.org/ofl
upl-1.0 | 75 | universal permissive | universal permissive licen[sc]e(?: version| v)? ?1\.0
mulan-2.0 | 75 | mulan | mulan(?: psl| permissive software licen[sc]e) ?v?2
mulan-1.0 | 75 | mulan | mulan(?: psl| permissive software licen[sc]e) ?v?1
cecill-2.1 | 75 | cecill | cecill(?: free software)?(?: licen[sc]e)?(?: agreement)?(?: version)? 2\.1
cecill-b | 75 | cecill | cecill-b\b
cecill-c | 75 | cecill | cecill-c\b
cecill | 50 | cecill | \bcecill\b
etalab-2.0 | 75 | licence ouverte | licence ouverte(?: version)? 2\.0
etalab | 60 | licence ouverte | licence ouverte
ogl-uk-3.0 | 75 | open government licence | open government licen[sc]e v ?3\.0
ogl-uk | 60 | open government licence | open government licen[sc]e
odbl-1.0 | 75 | open database license | open database licen[sc]e(?: v ?1\.0)?
odc-by-1.0 | 75 | open data commons attribution | open data commons attribution licen[sc]e
pddl-1.0 | 75 | public domain dedication and license | public domain dedication and licen[sc]e
cdla-permissive-2.0 | 80 | community data license agreement | community data licen[sc]e agreement permissive version 2\.0
cdla-permissive | 75 | community data license agreement | community data licen[sc]e agreement permissive
cdla-sharing | 75 | community data license agreement | community data licen[sc]e agreement sharing
cc0-1.0 | 75 | cc0 | \bcc0(?: 1\.0)?(?: universal)?
cc0-1.0 | 90 | creativecommons.org | creativecommons\.org/publicdomain/zero
cc-by-4.0 | 80 | creative commons | creative commons attribution 4\.0(?: international)?(?: licen[sc]e)?
cc-by-3.0 | 80 | creative commons | creative commons attribution 3\.0(?: unported)?(?: licen[sc]e)?
cc-by-2.0 | 80 | creative commons | creative commons attribution 2\.0(?: generic)?(?: licen[sc]e)?
cc-by-sa-4.0 | 85 | creative commons | creative commons attribution sharealike 4\.0(?: international)?(?: licen[sc]e)?
cc-by-sa-3.0 | 85 | creative commons | creative commons attribution sharealike 3\.0(?: unported)?(?: licen[sc]e)?
cc-by-nc-4.0 | 85 | creative commons | creative commons attribution noncommercial 4\.0(?: international)?(?: licen[sc]e)?
cc-by-nc-3.0 | 85 | creative commons | creative commons attribution noncommercial 3\.0(?: unported)?(?: licen[sc]e)?
cc-by-nd-4.0 | 85 | creative commons | creative commons attribution noderivatives 4\.0(?: international)?(?: licen[sc]e)?
cc-by-nc-sa-4.0 | 88 | creative commons | creative commons attribution noncommercial sharealike 4\.0(?: international)?(?: licen[sc]e)?
cc-by-nc-nd-4.0 | 88 | creative commons | creative commons attribution noncommercial noderivatives 4\.0(?: international)?(?: licen[sc]e)?
cc-by-4.0 | 90 | cc-by | \bcc-by-4\.0
cc-by-3.0 | 90 | cc-by | \bcc-by-3\.0
cc-by-sa-4.0 | 90 | cc-by-sa | \bcc-by-sa-4\.0
cc-by-sa-3.0 | 90 | cc-by-sa | \bcc-by-sa-3\.0
cc-by-nc-4.0 | 90 | cc-by-nc | \bcc-by-nc-4\.0
cc-by-nc-sa-4.0 | 90 | cc-by-nc-sa | \bcc-by-nc-sa-4\.0
cc-by-nc-nd-4.0 | 90 | cc-by-nc-nd | \bcc-by-nc-nd-4\.0
cc-by | 90 | creativecommons.org | creativecommons\.org/licenses/by/
cc-by-sa | 90 | creativecommons.org | creativecommons\.org/licenses/by-sa/
cc-by-nc | 90 | creativecommons.org | creativecommons\.org/licenses/by-nc/
cc-by-nd | 90 | creativecommons.org | creativecommons\.org/licenses/by-nd/
cc | 40 | creative commons | creative commons(?: attribution)? licen[sc]e
openrail | 75 | openrail | (?:creativeml |bigscience )?open ?rail(?: m)?(?: licen[sc]e)?
public-domain | 55 | public domain | (?:released|placed|dedicated) (?:in|into|to) the public domain
public-domain | 45 | public domain | in the public domain
proprietary | 50 | all rights reserved | proprietary and confidential all rights reserved
proprietary | 50 | unauthorized copying | unauthorized copying of this file via any medium is strictly prohibited
proprietary | 50 | commercial license | commercial licen[sc]e agreement
proprietary | 50 | end user license | end user licen[sc]e agreement
proprietary | 40 | confidential | confidential and proprietary
noncommercial | 40 | non-commercial | for non-commercial use only
noncommercial | 40 | noncommercial | for noncommercial use only
license-reference | 30 | license file | (?:see|found in) the licen[sc]e file
license-reference | 30 | see license | see licen[sc]e(?:\.txt|\.md)? for details
dual-license | 45 | dual licensed | dual licensed under
dual-license | 45 | dual-licensed | dual-licensed under
""".strip()


def needed(tree) -> list[frozenset[str]]:
    """Sets of words, one of each of which stands in whatever a parsed regex matches: its runs of letters and digits, and for
    a choice the longest that each of its alternatives needs."""
    out, run = [], ""
    for op, value in [*tree, (None, None)]:
        if op is sre.LITERAL and chr(value).isalnum():
            run += chr(value)
            continue
        if run:
            out.append(frozenset((run,)))
            run = ""
        if op is sre.SUBPATTERN:
            out += needed(value[3])
        elif op is sre.BRANCH and all(parts := [needed(x) for x in value[1]]):
            out.append(frozenset().union(*(max(x, key=rarity) for x in parts)))
    return out


def rarity(words: frozenset[str]) -> int:
    return min(map(len, words))


class Rule:
    def __init__(self, line: str):
        label, priority, _, pattern = (x.strip() for x in line.split(" | ", 3))
        self.label, self.priority = label, int(priority)
        # a space stands for any gap; the prefilter asks only for words that the regex can't match without
        self.regex = re.compile(pattern.replace(" ?", "\x00").replace(" ", r"[^\w]+?").replace("\x00", r"[^\w]*?"))
        self.keywords = tuple(dict.fromkeys(needed(sre_parse.parse(self.regex.pattern))))


@lru_cache(maxsize=1)
def rules() -> tuple[list[Rule], dict[str, list[Rule]]]:
    """All rules in order, and the rules by the words of their rarest (longest) keyword."""
    out, by = [Rule(x) for x in RULES_TEXT.splitlines()], {}
    for r in out:
        for k in max(r.keywords, key=rarity):
            by.setdefault(k, []).append(r)
    return out, by


@lru_cache(maxsize=1)
def keyword_automaton():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for k in rules()[1]:
        automaton.add_word(k, k)
    automaton.make_automaton()
    return automaton


def detections(low: str) -> list[tuple[int, int, str, int]]:
    """(start, end, label, priority) of what stays of the rules' matches in a lower-cased text, by place."""
    _, by = rules()
    found = []
    for r in {id(r): r for key in {k for _, k in keyword_automaton().iter(low)} for r in by[key]}.values():
        if all(any(w in low for w in k) for k in r.keywords):
            found += [(m.start(), m.end(), r.label, r.priority) for m in r.regex.finditer(low)]
    found.sort(key=lambda x: (-x[3], x[0] - x[1], x[0], x[2]))
    return sorted(suppress(found))


def suppress(ordered: list[tuple[int, int, str, int]]) -> list[tuple[int, int, str, int]]:
    """Drop every span inside one that comes before it. Kept spans that no other holds have rising starts and ends, so one
    binary search tells whether a span lies inside any of them."""
    from bisect import bisect_left, bisect_right

    starts: list[int] = []
    ends: list[int] = []
    kept = []
    for x in ordered:
        s, e = x[0], x[1]
        i = bisect_right(starts, s)
        if i and ends[i - 1] >= e:
            continue
        kept.append(x)
        j = bisect_left(starts, s)
        k = j
        while k < len(ends) and ends[k] <= e:  # outer spans only
            k += 1
        starts[j:k], ends[j:k] = [s], [e]
    return kept


def base_places(low: str) -> dict[str, list[int]]:
    """For each base label the word numbers where its phrase starts."""
    if "license" not in low:
        return {}
    words, out = WORD.findall(low), {}
    ends = [i for i, w in enumerate(words) if w == "license"]
    for label, phrase in BASE.items():
        n = len(phrase)
        if hits := [i - n + 1 for i in ends if i >= n - 1 and tuple(words[i - n + 1 : i + 1]) == phrase]:
            out[label] = hits
    return out


def scan_text(text: str | None) -> tuple[int, int, int | None, int | None, str, str, float, list[dict]]:
    text = text or ""
    low = text.lower() if text.isascii() else text.translate(LOWER)
    n_words = len(low.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split())
    base = base_places(low)
    places = [i for hits in base.values() for i in hits]
    found = detections(low)
    labels = sorted({*base, *(x[2] for x in found)})
    score = max([x[3] / 100 for x in found] + [0.6] * bool(base), default=0.0)
    spans = [{"start": s, "end": e, "label": label, "priority": p} for s, e, label, p in found]
    return n_words, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(labels), score, spans


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<start: int, end: int, label: string, priority: int>>"


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row its id, the counts and labels of SCHEMA and the detections that stay (code points, end exclusive)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("priority", pa.int32())]))]
        names = ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
        for batch, texts in slices(batches, 1):
            columns = zip(*map(scan_text, texts), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df, [F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")], work, f"id {kind}, {SCHEMA}").withColumnRenamed("id", id_col)
