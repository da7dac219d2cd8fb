"""Signatures of licenses: one rule a line, as ``priority confidence label keywords regex``.

A regex is held against lower-case words with one blank between them (punctuation is gone: "CC-BY 4.0" reads "cc by 4 0"). It
begins and ends with a whole word, holds one of its keywords (comma-separated parts of words), and repeats nothing without a bound.
Names in braces are the shorthands below. Of rules that meet in a place the higher priority goes first:
90 texts and notices of a license, 80 names with a version, 70 names, 50 abbreviations, 30 families, 10 general clues.
"""

from __future__ import annotations

import re
from typing import NamedTuple

SHORT = {
    "lic": r"licen[cs]e",
    "v": r"(?:version |ver |v |v)?",
    "under": r"(?:licen[cs]ed|released|distributed|published|available|provided|covered|offered|redistributed|dual licen[cs]ed) under(?: the)?(?: terms of)?(?: the)?",
    "later": r"(?: or(?: at your option)?(?: any)? (?:later|newer|greater)(?: version)?| and (?:later|above))",
    "cc": r"(?:creative commons|cc)",
    "by": r"(?:attribution|by)",
    "nc": r"(?:non commercial|noncommercial|nc)",
    "nd": r"(?:no deriv(?:ative|ivative|ative work)s?|noderiv(?:ative)?s?|no derivs|nd)",
    "sa": r"(?:share alike|sharealike|sa)",
    "gpl": r"(?:gnu general public licen[cs]e|general public licen[cs]e|gnu gpl|gpl)",
    "lgpl": r"(?:gnu (?:lesser|library)(?: or lesser)? general public licen[cs]e|(?:lesser|library) general public licen[cs]e|gnu lgpl|lgpl)",
    "agpl": r"(?:gnu affero general public licen[cs]e|affero general public licen[cs]e|affero gpl|gnu agpl|agpl)",
    "fdl": r"(?:gnu free documentation licen[cs]e|free documentation licen[cs]e|gnu fdl|gfdl)",
}

TABLE = r"""
90 0.99 mit permission permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
90 0.95 mit merchantability the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
90 0.97 mit mit,expat {under} (?:mit|mit x11|expat)(?: open source| software)?(?: {lic})?
90 0.90 mit copyright the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
80 0.95 mit mit spdx {lic} identifier mit
70 0.93 mit mit (?:the )?mit(?: open source| software)? {lic}
70 0.90 mit expat expat {lic}
50 0.75 mit mit (?:{lic} mit|mit licensed|licensed mit)
80 0.92 mit-0 mit mit (?:no attribution(?: {lic})?|0(?: {lic})?)
80 0.90 x11 x11 (?:x11|mit x11|x consortium|x11 mit)(?: style)? {lic}
70 0.85 mit-modern modern mit modern variant
70 0.85 mit-cmu cmu (?:cmu|mit cmu) {lic}
90 0.99 apache-2 apache {under} apache(?: software)? {lic} {v}2(?: 0)?
90 0.98 apache-2 apache you may not use this (?:file|work|software|project) except in compliance with the {lic} you may obtain a copy of the {lic} at https? www apache org licenses {lic} 2 0
90 0.97 apache-2 apache www apache org licenses {lic} 2 0(?: txt| html)?
80 0.97 apache-2 apache apache(?: software)? {lic} {v}2(?: 0)?
80 0.95 apache-2 apache spdx {lic} identifier apache 2 0
80 0.92 apache-2 apache,asl (?:apache|asl) (?:2 0|{v}2|2 0 {lic})
80 0.95 apache-1.1 apache apache(?: software)? {lic} {v}1 1
80 0.95 apache-1.0 apache apache(?: software)? {lic} {v}1(?: 0)?
70 0.85 apache apache (?:the )?apache(?: software)?(?: foundation)? {lic}
50 0.65 apache apache {lic} apache
90 0.99 bsd-3-clause endorse neither the name of [^ ]{{1,40}}(?: [^ ]{{1,40}}){{0,8}} nor the names of its contributors may be used to endorse or promote products derived from this software
90 0.95 bsd redistribution redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
90 0.93 bsd-2-clause redistributions redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
90 0.97 bsd-4-clause advertising all advertising materials mentioning features or use of this software must display the following acknowledg[e]?ment
80 0.96 bsd-3-clause bsd (?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)(?: {lic})?
80 0.96 bsd-2-clause bsd (?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)(?: {lic})?
80 0.96 bsd-4-clause bsd (?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd|old bsd)(?: {lic})?
80 0.95 0bsd bsd,free (?:0bsd|zero clause bsd|bsd 0 clause|bsd zero clause|free public {lic} 1 0 0)(?: {lic})?
80 0.92 bsd-1-clause bsd (?:bsd 1 clause|1 clause bsd|one clause bsd)(?: {lic})?
80 0.92 bsd-3-clause-clear bsd (?:clear bsd|bsd 3 clause clear)(?: {lic})?
80 0.92 bsd-2-clause-patent patent bsd (?:2 clause plus patent|2 clause patent|plus patent)(?: {lic})?
80 0.90 bsd-3-clause-lbnl bsd (?:lawrence berkeley|lbnl)(?: national labs)? bsd(?: variant)?(?: {lic})?
90 0.90 bsd bsd {under} (?:a )?bsd(?: style| type| like)?(?: {lic})?
70 0.85 bsd bsd (?:the )?bsd(?: style| type| like)? {lic}
50 0.60 bsd bsd (?:{lic} bsd|bsd licensed)
90 0.97 isc permission permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
70 0.90 isc isc (?:the )?isc {lic}
80 0.92 isc isc spdx {lic} identifier isc
90 0.98 gpl-2.0 general,gpl {under} {gpl} {v}2(?: 0)?
90 0.98 gpl-3.0 general,gpl {under} {gpl} {v}3(?: 0)?
90 0.98 gpl-2.0-or-later general,gpl {under} {gpl} {v}2(?: 0)?{later}
90 0.98 gpl-3.0-or-later general,gpl {under} {gpl} {v}3(?: 0)?{later}
90 0.97 gpl-2.0-or-later general under the terms of the gnu general public {lic} as published by the free software foundation either version 2 of the {lic}{later}
90 0.97 gpl-3.0-or-later general under the terms of the gnu general public {lic} as published by the free software foundation either version 3 of the {lic}{later}
90 0.90 gpl general under the terms of the gnu general public {lic} as published by the free software foundation
90 0.90 gpl gnu you should have received a copy of the gnu general public {lic} along with this (?:program|library|software|file|package)
90 0.93 gpl-3.0 gnu gnu general public {lic} version 3 29 june 2007
90 0.93 gpl-2.0 gnu gnu general public {lic} version 2 june 1991
80 0.96 gpl-1.0 general,gpl {gpl} {v}1(?: 0)?
80 0.96 gpl-2.0 general,gpl {gpl} {v}2(?: 0)?
80 0.96 gpl-3.0 general,gpl {gpl} {v}3(?: 0)?
80 0.97 gpl-2.0-or-later general,gpl {gpl} {v}2(?: 0)?{later}
80 0.97 gpl-3.0-or-later general,gpl {gpl} {v}3(?: 0)?{later}
80 0.95 gpl-2.0 gpl spdx {lic} identifier gpl 2 0(?: only)?
80 0.95 gpl-3.0 gpl spdx {lic} identifier gpl 3 0(?: only)?
80 0.96 gpl-2.0-or-later gpl gpl 2 0 or later
80 0.96 gpl-3.0-or-later gpl gpl 3 0 or later
80 0.85 gpl-2.0 gpl (?:gplv2|gpl2)
80 0.85 gpl-3.0 gpl (?:gplv3|gpl3)
80 0.92 gpl-2.0-with-classpath-exception classpath {gpl} {v}2(?: 0)? with(?: the)?(?: gnu)? classpath exception
80 0.90 gpl-3.0-with-gcc-exception gcc {gpl} {v}3(?: 0)? with(?: the)? gcc(?: runtime library)? exception
70 0.80 classpath-exception classpath (?:gnu )?classpath exception
70 0.85 gpl general (?:the )?(?:gnu )?general public {lic}
50 0.60 gpl gpl (?:gnu gpl|gpl {lic}|gpl licensed|{lic} gpl)
90 0.98 lgpl-2.0 general,lgpl {under} {lgpl} {v}2(?: 0)?
90 0.98 lgpl-2.1 general,lgpl {under} {lgpl} {v}2 1
90 0.98 lgpl-3.0 general,lgpl {under} {lgpl} {v}3(?: 0)?
90 0.90 lgpl general under the terms of the gnu (?:lesser|library) general public {lic} as published by the free software foundation
80 0.96 lgpl-2.0 general,lgpl {lgpl} {v}2(?: 0)?
80 0.96 lgpl-2.1 general,lgpl {lgpl} {v}2 1
80 0.96 lgpl-3.0 general,lgpl {lgpl} {v}3(?: 0)?
80 0.97 lgpl-2.1-or-later general,lgpl {lgpl} {v}2 1{later}
80 0.97 lgpl-3.0-or-later general,lgpl {lgpl} {v}3(?: 0)?{later}
80 0.85 lgpl-2.1 lgpl (?:lgplv2 1|lgpl2 1)
80 0.85 lgpl-3.0 lgpl (?:lgplv3|lgpl3)
70 0.87 lgpl general (?:gnu )?(?:lesser|library)(?: or lesser)? general public {lic}
50 0.65 lgpl lgpl (?:lgpl {lic}|gnu lgpl|{lic} lgpl)
90 0.98 agpl-3.0 affero,agpl {under} {agpl} {v}3(?: 0)?
90 0.92 agpl affero under the terms of the gnu affero general public {lic} as published by the free software foundation
80 0.96 agpl-3.0 affero,agpl {agpl} {v}3(?: 0)?
80 0.97 agpl-3.0-or-later affero,agpl {agpl} {v}3(?: 0)?{later}
80 0.95 agpl-1.0 affero,agpl {agpl} {v}1(?: 0)?
80 0.85 agpl-3.0 agpl (?:agplv3|agpl3)
70 0.88 agpl affero (?:gnu )?affero(?: general)? public {lic}
50 0.65 agpl agpl (?:agpl {lic}|gnu agpl|{lic} agpl)
90 0.96 gfdl documentation permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation {lic}
80 0.95 gfdl-1.1 documentation,fdl {fdl} {v}1 1
80 0.95 gfdl-1.2 documentation,fdl {fdl} {v}1 2
80 0.95 gfdl-1.3 documentation,fdl {fdl} {v}1 3
70 0.88 gfdl documentation,fdl {fdl}
90 0.97 cc-by creative this work is licensed under a creative commons attribution(?: [1-4] [0-9])?(?: international| unported| generic)? {lic}
90 0.97 cc-by-sa creative this work is licensed under a creative commons attribution {sa}(?: [1-4] [0-9])?(?: international| unported| generic)? {lic}
90 0.97 cc-by-nc creative this work is licensed under a creative commons attribution {nc}(?: [1-4] [0-9])?(?: international| unported| generic)? {lic}
90 0.97 cc-by-nd creative this work is licensed under a creative commons attribution {nd}(?: [1-4] [0-9])?(?: international| unported| generic)? {lic}
90 0.97 cc-by-nc-sa creative this work is licensed under a creative commons attribution {nc} {sa}(?: [1-4] [0-9])?(?: international| unported| generic)? {lic}
90 0.97 cc-by-nc-nd creative this work is licensed under a creative commons attribution {nc} {nd}(?: [1-4] [0-9])?(?: international| unported| generic)? {lic}
90 0.96 cc-by-nc cc,creative {under} {cc} {by} {nc}(?: [1-4] [0-9])?
90 0.96 cc-by-nc-sa cc,creative {under} {cc} {by} {nc} {sa}(?: [1-4] [0-9])?
90 0.96 cc-by-nc-nd cc,creative {under} {cc} {by} {nc} {nd}(?: [1-4] [0-9])?
90 0.95 cc-by-sa cc,creative {under} {cc} {by} {sa}(?: [1-4] [0-9])?
90 0.95 cc-by-nd cc,creative {under} {cc} {by} {nd}(?: [1-4] [0-9])?
90 0.94 cc-by cc,creative {under} {cc} {by}(?: [1-4] [0-9])?
90 0.97 cc-by creativecommons creativecommons org licenses by [1-4] [0-9]
90 0.97 cc-by-sa creativecommons creativecommons org licenses by sa [1-4] [0-9]
90 0.97 cc-by-nc creativecommons creativecommons org licenses by nc [1-4] [0-9]
90 0.97 cc-by-nd creativecommons creativecommons org licenses by nd [1-4] [0-9]
90 0.97 cc-by-nc-sa creativecommons creativecommons org licenses by nc sa [1-4] [0-9]
90 0.97 cc-by-nc-nd creativecommons creativecommons org licenses by nc nd [1-4] [0-9]
90 0.97 cc0-1.0 creativecommons creativecommons org publicdomain zero 1 0
80 0.93 cc-by cc,creative {cc} {by} [1-4] [0-9]
80 0.94 cc-by-sa cc,creative {cc} {by} {sa} [1-4] [0-9]
80 0.94 cc-by-nc cc,creative {cc} {by} {nc} [1-4] [0-9]
80 0.94 cc-by-nd cc,creative {cc} {by} {nd} [1-4] [0-9]
80 0.94 cc-by-nc-sa cc,creative {cc} {by} {nc} {sa} [1-4] [0-9]
80 0.94 cc-by-nc-nd cc,creative {cc} {by} {nc} {nd} [1-4] [0-9]
70 0.85 cc-by-sa cc,creative {cc} {by} {sa}
70 0.85 cc-by-nc cc,creative {cc} {by} {nc}
70 0.85 cc-by-nd cc,creative {cc} {by} {nd}
70 0.86 cc-by-nc-sa cc,creative {cc} {by} {nc} {sa}
70 0.86 cc-by-nc-nd cc,creative {cc} {by} {nc} {nd}
70 0.85 cc-by creative creative commons attribution
50 0.55 cc-by cc cc by {lic}
80 0.95 cc0-1.0 cc0 cc0 1 0(?: universal)?
80 0.93 cc0-1.0 creative creative commons (?:zero|cc0)(?: 1 0)?(?: universal)?
50 0.80 cc0-1.0 cc0 cc0
70 0.85 cc-pdm public public domain mark(?: 1 0)?
30 0.60 creative-commons creative creative commons(?: {lic})?
90 0.96 unlicense unencumbered this is free and unencumbered software released into the public domain
70 0.85 unlicense unlicense (?:the )?unlicense
90 0.85 public-domain public (?:released|placed|dedicated) (?:in|into|to) the public domain
70 0.70 public-domain public (?:is|are) in the public domain
10 0.35 public-domain public public domain
80 0.94 wtfpl wtfpl wtfpl
70 0.94 wtfpl public do what the fuck you want to public {lic}
80 0.95 mpl-1.0 mozilla,mpl (?:mozilla public {lic}|mpl) {v}1 0
80 0.96 mpl-1.1 mozilla,mpl (?:mozilla public {lic}|mpl) {v}1 1
80 0.97 mpl-2.0 mozilla,mpl (?:mozilla public {lic}|mpl) {v}2(?: 0)?
90 0.98 mpl-2.0 mozilla this source code form is subject to the terms of the mozilla public {lic} v 2 0
70 0.87 mpl mozilla mozilla public {lic}
80 0.95 epl-1.0 eclipse,epl (?:eclipse public {lic}|epl) {v}1(?: 0)?
80 0.95 epl-2.0 eclipse,epl (?:eclipse public {lic}|epl) {v}2(?: 0)?
70 0.87 epl eclipse eclipse public {lic}
80 0.92 edl-1.0 eclipse eclipse distribution {lic}(?: {v}1(?: 0)?)?
80 0.95 cddl-1.0 cddl,common (?:common development and distribution {lic}|cddl) {v}1(?: 0)?
80 0.95 cddl-1.1 cddl,common (?:common development and distribution {lic}|cddl) {v}1 1
70 0.87 cddl cddl,common (?:common development and distribution {lic}|cddl)
80 0.93 cpl-1.0 common common public {lic}(?: {v}1(?: 0)?)?
80 0.90 cpal-1.0 attribution common public attribution {lic}(?: {v}1(?: 0)?)?
80 0.92 ipl-1.0 ibm ibm public {lic}(?: {v}1(?: 0)?)?
80 0.95 eupl-1.1 eupl,union (?:european union public {lic}|eupl) {v}1 1
80 0.95 eupl-1.2 eupl,union (?:european union public {lic}|eupl) {v}1 2
70 0.88 eupl eupl,union (?:european union public {lic}|eupl)
80 0.94 bsl-1.0 boost boost software {lic}(?: {v}1(?: 0)?)?
70 0.80 bsl-1.0 boost boost {lic}
80 0.95 busl-1.1 business business source {lic}(?: {v}1 1)?
80 0.93 sspl-1.0 sspl,server (?:server side public {lic}|sspl)(?: {v}1(?: 0)?)?
80 0.93 elastic-2.0 elastic elastic {lic}(?: {v}2(?: 0)?)?
80 0.88 commons-clause commons commons clause(?: {lic})?(?: condition)?
80 0.92 polyform-noncommercial-1.0.0 polyform polyform noncommercial(?: {lic})?(?: 1 0 0)?
80 0.92 polyform-small-business-1.0.0 polyform polyform small business(?: {lic})?(?: 1 0 0)?
70 0.85 polyform polyform polyform(?: [a-z]{{1,20}})? {lic}
80 0.92 prosperity prosperity prosperity public {lic}(?: 3 0 0)?
80 0.90 parity parity parity public {lic}(?: 7 0 0)?
80 0.93 artistic-1.0 artistic artistic {lic} {v}1(?: 0)?
80 0.95 artistic-2.0 artistic artistic {lic} {v}2(?: 0)?
70 0.85 artistic artistic artistic {lic}
80 0.85 perl perl (?:same terms as perl|terms as perl itself)
80 0.93 zlib zlib (?:the )?zlib(?: libpng)? {lic}
90 0.93 zlib misrepresented the origin of this software must not be misrepresented you must not claim that you wrote the original software
80 0.92 libpng libpng libpng {lic}(?: {v}2)?
80 0.90 libtiff libtiff libtiff {lic}
80 0.90 ijg jpeg independent jpeg group(?: s)?(?: software)?(?: {lic})?
80 0.92 openssl openssl openssl {lic}
80 0.92 ssleay ssleay ssleay {lic}
80 0.92 curl curl curl {lic}
80 0.92 php-3.01 php php {lic} {v}3 01
70 0.87 php php php {lic}
80 0.94 psf-2.0 python python software foundation {lic}(?: {v}2(?: 0)?)?
70 0.87 python-2.0 python python {lic}(?: {v}2(?: 0)?)?
80 0.90 cnri-python cnri cnri(?: open source)?(?: python)? {lic}
70 0.88 ruby ruby ruby(?: s)? {lic}
80 0.92 postgresql postgresql postgresql {lic}
80 0.92 ncsa ncsa (?:university of illinois ncsa|ncsa)(?: open source)? {lic}
80 0.92 w3c w3c w3c(?: software(?: notice(?: and)?)?)? {lic}
80 0.92 unicode-dfs unicode unicode(?: inc)?(?: terms of use| {lic} agreement| {lic} v3| data files and software {lic})
80 0.90 icu icu icu {lic}
80 0.93 ofl-1.1 sil,ofl (?:sil open font {lic}|ofl)(?: {v}1 1)?
80 0.93 ofl-1.0 sil,ofl (?:sil open font {lic}|ofl) {v}1 0
70 0.87 ofl font open font {lic}
80 0.90 bitstream-vera bitstream bitstream vera(?: fonts?)?(?: {lic}| copyright)?
80 0.90 ubuntu-font-1.0 ubuntu ubuntu font {lic}(?: 1 0| {v}1 0)?
80 0.90 freetype freetype (?:freetype(?: project)?) {lic}
80 0.92 vim vim vim {lic}
80 0.92 tcl tcl tcl(?: tk)? {lic}
80 0.90 sleepycat sleepycat sleepycat {lic}
80 0.90 oracle-bcl binary oracle binary code {lic}(?: agreement)?
80 0.90 upl-1.0 universal universal permissive {lic}(?: {v}1(?: 0)?)?
80 0.92 ms-pl microsoft microsoft public {lic}
80 0.92 ms-rl microsoft microsoft reciprocal {lic}
80 0.85 ms-eula microsoft microsoft software {lic} terms
80 0.90 apsl-2.0 apple apple public source {lic}(?: {v}2(?: 0)?)?
80 0.90 nasa-1.3 nasa nasa open source agreement(?: {v}1 3)?
80 0.90 osl-3.0 open open software {lic}(?: {v}3(?: 0)?)?
80 0.90 afl-3.0 academic academic free {lic}(?: {v}3(?: 0)?)?
80 0.90 ecl-2.0 educational educational community {lic}(?: {v}2(?: 0)?)?
80 0.90 rpl-1.5 reciprocal reciprocal public {lic}(?: 1 5| {v}1 5)?
80 0.90 qpl-1.0 qpl,public (?:q public {lic}|qpl)(?: {v}1(?: 0)?)?
80 0.90 lppl-1.3c latex,lppl (?:latex project public {lic}|lppl)(?: {v}1 3c?)?
80 0.90 cecill-2.1 cecill cecill(?: free software)?(?: {lic})?(?: agreement)?(?: {v}2 1)?
80 0.90 cecill-b cecill cecill b(?: free software)?(?: {lic})?
80 0.90 cecill-c cecill cecill c(?: free software)?(?: {lic})?
80 0.90 mulanpsl-2.0 mulan mulan permissive software {lic}(?: {v}2| 2 0)?
80 0.90 blueoak-1.0.0 oak blue oak model {lic}(?: 1 0 0)?
80 0.90 hippocratic-2.1 hippocratic hippocratic {lic}(?: {v}2 1| 2 1)?
80 0.88 json evil the software shall be used for good not evil
80 0.88 beerware beer beer ?ware {lic}|beerware
80 0.88 naumen naumen naumen public {lic}
80 0.88 sunpl sun sun public {lic}(?: {v}1(?: 0)?)?
80 0.88 npl netscape netscape public {lic}(?: {v}1(?: 1| 0)?)?
80 0.88 intel-acpi intel intel(?: acpi| simplified software| open source)? {lic}
80 0.88 nvidia-eula nvidia nvidia(?: software| source code| cuda)? {lic}(?: agreement)?
80 0.92 odbl-1.0 odbl,database (?:open database {lic}|odbl)(?: {v}1(?: 0)?)?
80 0.92 odc-by-1.0 commons,odc (?:open data commons attribution {lic}|odc by)(?: {v}1(?: 0)?)?
80 0.92 pddl-1.0 public,pddl (?:public domain dedication and {lic}|pddl)(?: {v}1(?: 0)?)?
80 0.90 cdla-permissive cdla,community (?:community data {lic} agreement|cdla) permissive(?: (?:1|2) 0| {v}(?:1|2)(?: 0)?)?
80 0.90 cdla-sharing cdla,community (?:community data {lic} agreement|cdla) sharing(?: 1 0| {v}1(?: 0)?)?
80 0.90 ogl-uk-3.0 government open government {lic}(?: {v}3(?: 0)?)?
80 0.90 etalab-2.0 etalab,ouverte (?:etalab(?: open {lic})?|licence ouverte)(?: {v}2(?: 0)?)?
80 0.90 dl-de-by-2.0 deutschland datenlizenz deutschland(?: namensnennung)?(?: {v}2(?: 0)?)?
80 0.92 openrail rail (?:creativeml |bigscience )?open ?rail(?: m)?(?: {lic})?
80 0.92 bigscience-bloom-rail rail bigscience rail {lic}(?: {v}1(?: 0)?)?
80 0.92 llama2 llama llama 2 community {lic}(?: agreement)?
80 0.92 llama3 llama (?:meta )?llama 3(?: [123])? community {lic}(?: agreement)?
80 0.90 gemma-terms gemma gemma terms of use
80 0.90 open-game-license game open game {lic}(?: {v}1 0a?)?
80 0.90 fal-1.3 art free art {lic}(?: 1 3| {v}1 3)?
80 0.88 design-science design design science {lic}
80 0.88 cern-ohl cern cern(?: open hardware| ohl)(?: {lic})?(?: {v}(?:1 2|2))?
80 0.88 solderpad solderpad solderpad(?: hardware)? {lic}(?: {v}(?:0 51|2 1))?
80 0.88 tapr-ohl tapr tapr open hardware {lic}
30 0.70 proprietary proprietary (?:proprietary and confidential|confidential and proprietary|proprietary software|proprietary {lic})
30 0.75 proprietary unauthori[sz]ed unauthori[sz]ed (?:copying|reproduction|distribution|use)(?: or (?:copying|reproduction|distribution|use))? (?:of this (?:file|work|document|material|publication) )?(?:is|are) (?:strictly )?prohibited
30 0.70 all-rights-reserved rights all rights (?:are )?reserved
30 0.65 all-rights-reserved rechte alle rechte vorbehalten
30 0.65 all-rights-reserved droits tous droits r\xc3\xa9serv\xc3\xa9s
30 0.65 all-rights-reserved derechos todos los derechos reservados
30 0.55 some-rights-reserved rights some rights reserved
30 0.60 permission-required permission (?:no part of this (?:publication|book|work) may be (?:reproduced|copied|distributed)|may not be reproduced) without(?: the)?(?: prior)?(?: written)? permission
30 0.55 non-commercial commercial for (?:non commercial|noncommercial|personal and non commercial|personal non commercial) use only
30 0.50 evaluation evaluation for evaluation(?: purposes)? only
30 0.50 research-only research for research(?: purposes)? only
30 0.50 eula agreement end user {lic} agreement
30 0.50 open-source source (?:an )?open source {lic}
30 0.45 free-software free free software {lic}
10 0.40 licensed licen (?:this|the) (?:work|software|program|file|document|project|material|dataset|page|content) is licen[cs]ed under
10 0.35 see-license licen (?:see|refer to)(?: the)? {lic}(?: file)? for (?:more )?(?:details|information|terms)
10 0.30 spdx spdx spdx {lic} identifier
10 0.30 copyright copyright copyright (?:c )?(?:19|20)[0-9]{{2}}
"""


class Rule(NamedTuple):
    number: int
    priority: int
    confidence: float
    label: str
    keywords: tuple[str, ...]
    pattern: re.Pattern


def rules(table: str = TABLE, short: dict[str, str] = SHORT) -> list[Rule]:
    """The rules of a table in its format, in their order; a regex that repeats without a bound is refused."""
    out = []
    for number, line in enumerate(x for x in table.splitlines() if x.strip()):
        priority, confidence, label, keywords, regex = line.split(maxsplit=4)
        regex = regex.format(**short)
        if re.search(r"(?<!\[)[*+](?!\])", regex):
            raise ValueError(f"rule without a bound: {line}")
        out.append(Rule(number, int(priority), float(confidence), label, tuple(keywords.split(",")), re.compile(f" (?:{regex})(?= )")))
    return out
