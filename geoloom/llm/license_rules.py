"""Signatures of licenses, each written by hand: (label, kind, keyword, pattern), the most important first.

Patterns see lower-cased text; a blank of a pattern stands for any run of blanks,
line ends and comment marks.  Every match of a rule contains its keyword.  Kinds:
``tag`` (machine-readable), ``text`` (a sentence of the license itself),
``notice`` (a sentence that puts something under it) and ``name`` (a mere name).
"""

RULES = [
    # machine-readable tags
    ("gpl-2.0-or-later", "tag", "spdx", r"spdx-license-identifier: ?\(?gpl-2\.0(?:-or-later|\+)"),
    ("gpl-2.0-only", "tag", "spdx", r"spdx-license-identifier: ?\(?gpl-2\.0(?:-only)?(?![-+\w.])"),
    ("gpl-3.0-or-later", "tag", "spdx", r"spdx-license-identifier: ?\(?gpl-3\.0(?:-or-later|\+)"),
    ("gpl-3.0-only", "tag", "spdx", r"spdx-license-identifier: ?\(?gpl-3\.0(?:-only)?(?![-+\w.])"),
    ("gpl-2.0-with-classpath-exception", "tag", "classpath", r"spdx-license-identifier: ?\(?gpl-2\.0(?:-only|-or-later|\+)? with classpath-exception-2\.0"),
    ("gpl-3.0-with-gcc-exception", "tag", "gcc-exception", r"spdx-license-identifier: ?\(?gpl-3\.0(?:-only|-or-later|\+)? with gcc-exception-3\.1"),
    ("gpl-2.0-with-linux-syscall-note", "tag", "syscall", r"spdx-license-identifier: ?\(?gpl-2\.0(?:-only|-or-later|\+)? with linux-syscall-note"),
    ("lgpl-2.1-or-later", "tag", "spdx", r"spdx-license-identifier: ?\(?lgpl-2\.1(?:-or-later|\+)"),
    ("lgpl-2.1-only", "tag", "spdx", r"spdx-license-identifier: ?\(?lgpl-2\.1(?:-only)?(?![-+\w.])"),
    ("lgpl-3.0-or-later", "tag", "spdx", r"spdx-license-identifier: ?\(?lgpl-3\.0(?:-or-later|\+)"),
    ("lgpl-3.0-only", "tag", "spdx", r"spdx-license-identifier: ?\(?lgpl-3\.0(?:-only)?(?![-+\w.])"),
    ("agpl-3.0-or-later", "tag", "spdx", r"spdx-license-identifier: ?\(?agpl-3\.0(?:-or-later|\+)"),
    ("agpl-3.0-only", "tag", "spdx", r"spdx-license-identifier: ?\(?agpl-3\.0(?:-only)?(?![-+\w.])"),
    ("apache-2.0-with-llvm-exception", "tag", "llvm", r"spdx-license-identifier: ?\(?apache-2\.0 with llvm-exception"),
    ("apache-2.0 or mit", "tag", "spdx", r"spdx-license-identifier: ?\(?(?:apache-2\.0 or mit|mit or apache-2\.0)(?![-\w])"),
    ("apache-2.0", "tag", "spdx", r"spdx-license-identifier: ?\(?apache-2\.0(?![-\w])"),
    ("mit", "tag", "spdx", r"spdx-license-identifier: ?\(?mit(?![-\w])"),
    ("mit-0", "tag", "spdx", r"spdx-license-identifier: ?\(?mit-0\b"),
    ("bsd-2-clause", "tag", "spdx", r"spdx-license-identifier: ?\(?bsd-2-clause(?:-patent|-views)?\b"),
    ("bsd-3-clause", "tag", "spdx", r"spdx-license-identifier: ?\(?bsd-3-clause(?:-clear|-lbnl)?\b"),
    ("bsd-4-clause", "tag", "spdx", r"spdx-license-identifier: ?\(?bsd-4-clause(?:-uc)?\b"),
    ("0bsd", "tag", "spdx", r"spdx-license-identifier: ?\(?0bsd\b"),
    ("isc", "tag", "spdx", r"spdx-license-identifier: ?\(?isc\b"),
    ("mpl-2.0", "tag", "spdx", r"spdx-license-identifier: ?\(?mpl-2\.0(?:-no-copyleft-exception)?\b"),
    ("epl-2.0", "tag", "spdx", r"spdx-license-identifier: ?\(?epl-2\.0\b"),
    ("epl-1.0", "tag", "spdx", r"spdx-license-identifier: ?\(?epl-1\.0\b"),
    ("eupl-1.2", "tag", "spdx", r"spdx-license-identifier: ?\(?eupl-1\.2\b"),
    ("cc0-1.0", "tag", "spdx", r"spdx-license-identifier: ?\(?cc0-1\.0\b"),
    ("cc-by-4.0", "tag", "spdx", r"spdx-license-identifier: ?\(?cc-by-4\.0\b"),
    ("cc-by-sa-4.0", "tag", "spdx", r"spdx-license-identifier: ?\(?cc-by-sa-4\.0\b"),
    ("unlicense", "tag", "spdx", r"spdx-license-identifier: ?\(?unlicense\b"),
    ("zlib", "tag", "spdx", r"spdx-license-identifier: ?\(?zlib\b"),
    ("bsl-1.0", "tag", "spdx", r"spdx-license-identifier: ?\(?bsl-1\.0\b"),
    ("cddl", "tag", "spdx", r"spdx-license-identifier: ?\(?cddl-1\.[01]\b"),
    ("ofl", "tag", "spdx", r"spdx-license-identifier: ?\(?ofl-1\.[01]\b"),
    ("spdx-other", "tag", "spdx", r"spdx-license-identifier: ?\(?[a-z0-9][a-z0-9.+-]*"),
    ("spdx-file-copyright", "tag", "spdx", r"spdx-filecopyrighttext: ?(?:\(c\) ?|© ?)?(?:19|20)[0-9]{2}"),
    ("python-classifier", "tag", "classifier", r"classifier: ?license :: osi approved :: [a-z0-9 ().+-]{2,60}"),
    ("manifest-mit", "tag", "mit", r"\"license\" ?: ?\"mit\""),
    ("manifest-apache", "tag", "apache", r"\"license\" ?: ?\"apache-2\.0\""),
    ("manifest-isc", "tag", "isc", r"\"license\" ?: ?\"isc\""),
    ("manifest-bsd", "tag", "bsd", r"\"license\" ?: ?\"bsd(?:-[234]-clause)?\""),
    ("manifest-gpl", "tag", "gpl", r"\"license\" ?: ?\"[al]?gpl-?[v0-9.]*(?:-only|-or-later|\+)?\""),
    # the GNU family: notices with versions, then without, then sentences of the texts
    ("gpl-2.0-or-later", "notice", "general", r"(?:under the terms of )?the gnu general public license as published by the free software foundation[;,]? either version 2(?:\.0)? of the license,? or \(?at your option\)? any later version"),
    ("gpl-3.0-or-later", "notice", "general", r"(?:under the terms of )?the gnu general public license as published by the free software foundation[;,]? either version 3(?:\.0)? of the license,? or \(?at your option\)? any later version"),
    ("gpl-2.0-only", "notice", "general", r"(?:under the terms of )?the gnu general public license,? version 2(?:\.0)?,? as published by the free software foundation"),
    ("gpl-3.0-only", "notice", "general", r"(?:under the terms of )?the gnu general public license,? version 3(?:\.0)?,? as published by the free software foundation"),
    ("lgpl-2.1-or-later", "notice", "lesser", r"(?:under the terms of )?the gnu lesser general public license as published by the free software foundation[;,]? either version 2\.1 of the license,? or \(?at your option\)? any later version"),
    ("lgpl-3.0-or-later", "notice", "lesser", r"(?:under the terms of )?the gnu lesser general public license as published by the free software foundation[;,]? either version 3(?:\.0)? of the license,? or \(?at your option\)? any later version"),
    ("lgpl-2.0-or-later", "notice", "library", r"(?:under the terms of )?the gnu library general public license as published by the free software foundation[;,]? either version 2(?:\.0)? of the license,? or \(?at your option\)? any later version"),
    ("agpl-3.0-or-later", "notice", "affero", r"(?:under the terms of )?the gnu affero general public license as published by the free software foundation[;,]? either version 3(?:\.0)? of the license,? or \(?at your option\)? any later version"),
    ("gpl-2.0", "notice", "general", r"(?:released|licensed|distributed|available|published|provided|covered) (?:under|by) (?:the )?(?:terms of )?(?:the )?(?:gnu )?general public license,? ?\(?(?:version |v\.? ?)2(?:\.0)?\b\)?"),
    ("gpl-3.0", "notice", "general", r"(?:released|licensed|distributed|available|published|provided|covered) (?:under|by) (?:the )?(?:terms of )?(?:the )?(?:gnu )?general public license,? ?\(?(?:version |v\.? ?)3(?:\.0)?\b\)?"),
    ("agpl", "notice", "affero", r"(?:released|licensed|distributed|available|published|provided|covered) (?:under|by) (?:the )?(?:terms of )?(?:the )?(?:gnu )?affero general public license"),
    ("lgpl", "notice", "general", r"(?:released|licensed|distributed|available|published|provided|covered) (?:under|by) (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:lesser|library) general public license"),
    ("gpl", "notice", "general", r"(?:released|licensed|distributed|available|published|provided|covered) (?:under|by) (?:the )?(?:terms of )?(?:the )?(?:gnu )?general public license"),
    ("gpl", "notice", "general", r"(?:under|subject to) the terms of (?:the )?(?:gnu )?general public license"),
    ("lgpl", "notice", "general", r"(?:under|subject to) the terms of (?:the )?(?:gnu )?(?:lesser|library) general public license"),
    ("gpl", "notice", "gpl", r"(?:released|licensed|distributed|available|published|provided) under (?:the )?(?:gnu )?gpl(?:[ -]?v?[23](?:\.0)?\+?)?(?![\w.]*\w)"),
    ("lgpl", "notice", "lgpl", r"(?:released|licensed|distributed|available|published|provided) under (?:the )?(?:gnu )?lgpl(?:[ -]?v?[23](?:\.[01])?\+?)?(?![\w.]*\w)"),
    ("agpl", "notice", "agpl", r"(?:released|licensed|distributed|available|published|provided) under (?:the )?(?:gnu )?agpl(?:[ -]?v?3(?:\.0)?\+?)?(?![\w.]*\w)"),
    ("gfdl", "notice", "documentation", r"(?:copy, distribute and/or modify this document )?under the terms of the gnu free documentation license,? version 1\.[1-3]"),
    ("gfdl", "text", "cover", r"with no invariant sections,? (?:with )?no front-cover texts,? and (?:with )?no back-cover texts"),
    ("gpl", "text", "general", r"you should have received a copy of the gnu general public license along with this (?:program|file|library|package)"),
    ("lgpl", "text", "general", r"you should have received a copy of the gnu (?:lesser|library) general public license along with this (?:program|file|library|package)"),
    ("agpl", "text", "affero", r"you should have received a copy of the gnu affero general public license along with this (?:program|file|library|package)"),
    ("gpl", "text", "designed", r"the licenses for most software (?:and other practical works )?are designed to take away your freedom to share and change"),
    ("gpl-3.0", "text", "copyleft", r"the gnu general public license is a free, copyleft license for software and other kinds of works"),
    ("agpl-3.0", "text", "affero", r"the gnu affero general public license is a free, copyleft license for software and other kinds of works"),
    ("gpl", "text", "verbatim", r"everyone is permitted to copy and distribute verbatim copies of this license document,? but changing it is not allowed"),
    ("gpl-2.0", "text", "verbatim", r"you may copy and distribute verbatim copies of the program's source code as you receive it,? in any medium"),
    ("gpl-3.0", "text", "convey", r"you may convey verbatim copies of the program's source code as you receive it,? in any medium"),
    ("agpl-3.0", "text", "remotely", r"all users interacting with it remotely through a computer network"),
    ("gpl-warranty", "text", "merchantability", r"without any warranty;? without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("lgpl", "text", "licensed", r"this license,? the lesser general public license,? applies to some specially designated software packages(?:, typically libraries,)? (?:of the free software foundation )?licensed"),
    ("classpath-exception", "text", "independent", r"link this library with independent modules to produce an executable"),
    ("gcc-exception", "text", "runtime", r"gcc runtime library exception,? version 3\.1"),
    ("agpl-3.0", "name", "affero", r"(?:gnu )?affero general public licen[sc]e,? ?\(?(?:version |v\.? ?)3(?:\.0)?\b"),
    ("lgpl-2.1", "name", "lesser", r"(?:gnu )?lesser general public licen[sc]e,? ?\(?(?:version |v\.? ?)2\.1\b"),
    ("lgpl-3.0", "name", "lesser", r"(?:gnu )?lesser general public licen[sc]e,? ?\(?(?:version |v\.? ?)3(?:\.0)?\b"),
    ("gpl-2.0", "name", "general", r"(?:gnu )?general public licen[sc]e,? ?\(?(?:version |v\.? ?)2(?:\.0)?\b"),
    ("gpl-3.0", "name", "general", r"(?:gnu )?general public licen[sc]e,? ?\(?(?:version |v\.? ?)3(?:\.0)?\b"),
    ("agpl", "name", "affero", r"(?:gnu )?affero general public licen[sc]e"),
    ("lgpl", "name", "general", r"(?:gnu )?(?:lesser|library) general public licen[sc]e"),
    ("gpl", "name", "general", r"(?:gnu )?general public licen[sc]e"),
    ("gfdl", "name", "documentation", r"(?:gnu )?free documentation licen[sc]e"),
    ("agpl", "name", "agpl", r"\bagpl(?:[ -]?v?3(?:\.0)?\+?)?\b"),
    ("lgpl", "name", "lgpl", r"\blgpl(?:[ -]?v?(?:2\.1|2|3)(?:\.0)?\+?)?\b"),
    ("gpl", "name", "gpl", r"\bgpl(?:[ -]?v?[23](?:\.0)?\+?)?\b"),
    ("gfdl", "name", "gfdl", r"\bgfdl(?:[ -]?v?1\.[1-3])?\b"),
    # Creative Commons
    ("cc-by-nc-nd-4.0", "tag", "creativecommons", r"creativecommons\.org/licenses/by-nc-nd/4\.0"),
    ("cc-by-nc-nd", "tag", "creativecommons", r"creativecommons\.org/licenses/by-nc-nd/[123]\.[05]"),
    ("cc-by-nc-sa-4.0", "tag", "creativecommons", r"creativecommons\.org/licenses/by-nc-sa/4\.0"),
    ("cc-by-nc-sa", "tag", "creativecommons", r"creativecommons\.org/licenses/by-nc-sa/[123]\.[05]"),
    ("cc-by-nc-4.0", "tag", "creativecommons", r"creativecommons\.org/licenses/by-nc/4\.0"),
    ("cc-by-nc", "tag", "creativecommons", r"creativecommons\.org/licenses/by-nc/[123]\.[05]"),
    ("cc-by-nd", "tag", "creativecommons", r"creativecommons\.org/licenses/by-nd/[1234]\.[05]"),
    ("cc-by-sa-4.0", "tag", "creativecommons", r"creativecommons\.org/licenses/by-sa/4\.0"),
    ("cc-by-sa", "tag", "creativecommons", r"creativecommons\.org/licenses/by-sa/[123]\.[05]"),
    ("cc-by-4.0", "tag", "creativecommons", r"creativecommons\.org/licenses/by/4\.0"),
    ("cc-by", "tag", "creativecommons", r"creativecommons\.org/licenses/by/[123]\.[05]"),
    ("cc0-1.0", "tag", "creativecommons", r"creativecommons\.org/publicdomain/zero/1\.0"),
    ("cc-pdm", "tag", "creativecommons", r"creativecommons\.org/publicdomain/mark/1\.0"),
    ("cc-by-nc-nd", "notice", "commercial", r"licensed under (?:a |the )?(?:creative commons )?attribution[ -]non-?commercial[ -]no-?deriv(?:ative)?s(?: [1-4]\.[05])?"),
    ("cc-by-nc-sa", "notice", "commercial", r"licensed under (?:a |the )?(?:creative commons )?attribution[ -]non-?commercial[ -]share-?alike(?: [1-4]\.[05])?"),
    ("cc-by-nc", "notice", "commercial", r"licensed under (?:a |the )?(?:creative commons )?attribution[ -]non-?commercial(?: [1-4]\.[05])?"),
    ("cc-by-nd", "notice", "attribution", r"licensed under (?:a |the )?(?:creative commons )?attribution[ -]no-?deriv(?:ative)?s(?: [1-4]\.[05])?"),
    ("cc-by-sa", "notice", "attribution", r"licensed under (?:a |the )?(?:creative commons )?attribution[ -]share-?alike(?: [1-4]\.[05])?"),
    ("cc-by", "notice", "attribution", r"licensed under (?:a |the )?creative commons attribution(?: [1-4]\.[05])?(?: (?:international|unported|generic))?(?: licen[sc]e)?"),
    ("cc-by-nc-nd", "notice", "cc", r"(?:licensed|released|available|published|shared|distributed) under (?:a |the )?cc[ -]by[ -]nc[ -]nd(?: [1-4]\.[05])?"),
    ("cc-by-nc-sa", "notice", "cc", r"(?:licensed|released|available|published|shared|distributed) under (?:a |the )?cc[ -]by[ -]nc[ -]sa(?: [1-4]\.[05])?"),
    ("cc-by-nc", "notice", "cc", r"(?:licensed|released|available|published|shared|distributed) under (?:a |the )?cc[ -]by[ -]nc\b(?: [1-4]\.[05])?"),
    ("cc-by-nd", "notice", "cc", r"(?:licensed|released|available|published|shared|distributed) under (?:a |the )?cc[ -]by[ -]nd\b(?: [1-4]\.[05])?"),
    ("cc-by-sa", "notice", "cc", r"(?:licensed|released|available|published|shared|distributed) under (?:a |the )?cc[ -]by[ -]sa\b(?: [1-4]\.[05])?"),
    ("cc-by", "notice", "cc", r"(?:licensed|released|available|published|shared|distributed) under (?:a |the )?cc[ -]by\b(?: [1-4]\.[05])?"),
    ("cc0", "notice", "cc0", r"(?:licensed|released|available|published|dedicated) under (?:the )?cc0(?: 1\.0)?"),
    ("cc0", "text", "dedicated", r"has dedicated the work to the public domain by waiving all (?:of )?his or her rights to the work"),
    ("cc0", "text", "waives", r"affirmer hereby overtly, fully, permanently, irrevocably and unconditionally waives"),
    ("cc-by", "text", "appropriate", r"you must give appropriate credit, provide a link to the license, and indicate if changes were made"),
    ("cc-by-sa", "text", "contributions", r"if you remix, transform, or build upon the material, you must distribute your contributions under the same license"),
    ("cc-by-nc", "text", "commercial", r"you may not use the material for commercial purposes"),
    ("cc-by-nd", "text", "remix", r"if you remix, transform, or build upon the material, you may not distribute the modified material"),
    ("cc-by-nc-nd", "name", "commercial", r"creative commons attribution[ -]non-?commercial[ -]no-?deriv(?:ative)?s"),
    ("cc-by-nc-sa", "name", "commercial", r"creative commons attribution[ -]non-?commercial[ -]share-?alike"),
    ("cc-by-nc", "name", "commercial", r"creative commons attribution[ -]non-?commercial"),
    ("cc-by-nd", "name", "creative", r"creative commons attribution[ -]no-?deriv(?:ative)?s"),
    ("cc-by-sa", "name", "creative", r"creative commons attribution[ -]share-?alike"),
    ("cc-by", "name", "creative", r"creative commons attribution(?: [1-4]\.[05])?"),
    ("cc0", "name", "creative", r"creative commons (?:zero|cc0|public domain dedication)"),
    ("cc-by-nc-nd", "name", "cc", r"\bcc[ -]by[ -]nc[ -]nd(?:[ -][1-4]\.[05])?\b"),
    ("cc-by-nc-sa", "name", "cc", r"\bcc[ -]by[ -]nc[ -]sa(?:[ -][1-4]\.[05])?\b"),
    ("cc-by-nc", "name", "cc", r"\bcc[ -]by[ -]nc(?:[ -][1-4]\.[05])?\b"),
    ("cc-by-nd", "name", "cc", r"\bcc[ -]by[ -]nd(?:[ -][1-4]\.[05])?\b"),
    ("cc-by-sa", "name", "cc", r"\bcc[ -]by[ -]sa(?:[ -][1-4]\.[05])?\b"),
    ("cc-by", "name", "cc", r"\bcc[ -]by(?:[ -][1-4]\.[05])?\b"),
    ("cc0", "name", "cc0", r"\bcc0(?:[ -]1\.0)?\b"),
    # Apache
    ("apache-2.0", "notice", "apache", r"licensed under the apache license,? version 2\.0(?: \(the [\"“]?license[\"”]?\))?;? ?you may not use this file except in compliance with the license"),
    ("apache-2.0", "notice", "apache", r"(?:released|licensed|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?apache (?:software )?licen[sc]e,? ?\(?(?:version |v\.? ?)?2(?:\.0)?\b"),
    ("apache-1.1", "notice", "apache", r"(?:released|licensed|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?apache (?:software )?licen[sc]e,? ?\(?(?:version |v\.? ?)?1\.[01]\b"),
    ("apache", "notice", "apache", r"(?:released|licensed|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?apache (?:software )?licen[sc]e"),
    ("apache-2.0", "notice", "contributor", r"licensed to the apache software foundation \(asf\) under one or more contributor license agreements"),
    ("apache-2.0", "tag", "apache", r"apache\.org/licenses/license-2\.0"),
    ("apache-2.0", "text", "distributed", r"unless required by applicable law or agreed to in writing,? software distributed under the license is distributed on an [\"“]?as is[\"”]? basis"),
    ("apache-2.0", "text", "patent", r"each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable (?:\(except as stated in this section\) )?patent license"),
    ("apache-2.0", "text", "permissions", r"see the license for the specific language governing permissions and limitations under the license"),
    ("apache-1.1", "text", "apache", r"this product includes software developed by the apache software foundation"),
    ("apache-2.0", "name", "apache", r"\bapache (?:software )?licen[sc]e,? ?\(?(?:version |v\.? ?)?2(?:\.0)?\b"),
    ("apache", "name", "apache", r"\bapache (?:software )?licen[sc]e"),
    ("apache-2.0", "name", "apache", r"\bapache[ -]2(?:\.0)?\b"),
    # MIT and its kin
    ("mit", "text", "hereby", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files(?: \(the [\"“]?software[\"”]?\),? to deal in the software without restriction)?"),
    ("mit", "text", "hereby", r"permission is hereby granted, free of charge, to any person"),
    ("mit", "text", "substantial", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "text", "noninfringement", r"including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement"),
    ("mit", "text", "holders", r"in no event shall the authors or copyright holders be liable for any claim, damages or other liability"),
    ("mit", "notice", "mit", r"(?:released|licensed|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?mit(?:[ -]licen[sc]e)?\b"),
    ("mit", "notice", "mit", r"\blicen[sc]e ?[:=] ?[\"']?mit\b"),
    ("mit", "tag", "opensource", r"opensource\.org/licenses/mit\b"),
    ("x11", "text", "consortium", r"except as contained in this notice, the name of the x consortium shall not be used in advertising"),
    ("mit-advertising", "text", "sublicense", r"use, copy, modify, merge, publish, distribute, sublicense,? and/or sell copies of the software"),
    ("hpnd", "text", "hereby", r"permission to use, copy, modify,? and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted"),
    ("isc", "text", "hereby", r"permission to use, copy, modify,? and/or distribute this software for any purpose with or without fee is hereby granted,? provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", "text", "hereby", r"permission to use, copy, modify,? and/?(?:or)? ?distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "notice", "isc", r"(?:released|licensed|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?isc licen[sc]e"),
    ("mit", "name", "mit", r"\b(?:the )?mit[ -]licen[sc]e(?:d)?\b"),
    ("expat", "name", "expat", r"\bexpat licen[sc]e\b"),
    ("isc", "name", "isc", r"\b(?:the )?isc[ -]licen[sc]e\b"),
    # BSD
    ("bsd-3-clause", "text", "endorse", r"neither the name of (?:the )?[\w.,' -]{1,80} nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "text", "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd", "text", "redistribution", r"redistribution and use in source and binary forms,? with or without modification,? are permitted provided that the following conditions are met"),
    ("bsd", "text", "redistribution", r"redistribution and use in source and binary forms"),
    ("bsd", "text", "redistributions", r"redistributions of source code must retain the above copyright notice,? this list of conditions and the following disclaimer"),
    ("bsd", "text", "redistributions", r"redistributions in binary form must reproduce the above copyright notice,? this list of conditions and the following disclaimer"),
    ("bsd", "text", "exemplary", r"in no event shall the (?:copyright (?:holder|owner)s?|authors?|regents) (?:or contributors )?be liable for any direct, indirect, incidental, special, exemplary, or consequential damages"),
    ("bsd-2-clause-views", "text", "representing", r"should not be interpreted as representing official policies,? either expressed or implied"),
    ("bsd-style", "notice", "bsd", r"use of this source code is governed by a bsd-style license"),
    ("mit-style", "notice", "mit", r"use of this source code is governed by an mit-style license"),
    ("bsd-3-clause", "notice", "bsd", r"(?:released|licensed|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?(?:(?:3|three)[ -]clause|new|modified|revised) bsd(?: licen[sc]e)?"),
    ("bsd-2-clause", "notice", "bsd", r"(?:released|licensed|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?(?:(?:2|two)[ -]clause|simplified) bsd(?: licen[sc]e)?"),
    ("bsd", "notice", "bsd", r"(?:released|licensed|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?bsd(?: licen[sc]e)?"),
    ("bsd-3-clause", "name", "bsd", r"\b(?:(?:3|three)[ -]clause bsd|bsd[ -](?:3|three)[ -]clause|(?:new|modified|revised) bsd)(?: licen[sc]e)?"),
    ("bsd-2-clause", "name", "bsd", r"\b(?:(?:2|two)[ -]clause bsd|bsd[ -](?:2|two)[ -]clause|simplified bsd|freebsd licen[sc]e)(?: licen[sc]e)?"),
    ("bsd-4-clause", "name", "bsd", r"\b(?:(?:4|four)[ -]clause bsd|bsd[ -](?:4|four)[ -]clause|original bsd)(?: licen[sc]e)?"),
    ("bsd", "name", "bsd", r"\bbsd[ -]licen[sc]e(?:d)?\b"),
    # Mozilla, Eclipse, CDDL, EUPL and other weak copyleft
    ("mpl-2.0", "notice", "mozilla", r"this source code form is subject to the terms of the mozilla public license,? v\. ?2\.0"),
    ("mpl-1.1", "notice", "mozilla", r"the contents of this file are subject to the mozilla public license version 1\.1"),
    ("mpl-1.0", "notice", "mozilla", r"the contents of this file are subject to the mozilla public license version 1\.0"),
    ("mpl-2.0", "text", "incompatible", r"incompatible with secondary licenses[\"”]?,? as defined by the mozilla public license"),
    ("mpl", "notice", "mozilla", r"(?:released|licensed|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?mozilla public licen[sc]e"),
    ("mpl", "notice", "mozilla", r"under the terms of (?:the )?mozilla public licen[sc]e"),
    ("mpl-2.0", "tag", "mozilla", r"mozilla\.org/mpl/2\.0"),
    ("mpl", "name", "mozilla", r"\bmozilla public licen[sc]e(?:,? (?:version |v\.? ?)?[12]\.[01])?"),
    ("mpl", "name", "mpl", r"\bmpl[ -]?v?(?:1\.[01]|2\.0)\b"),
    ("npl", "name", "netscape", r"\bnetscape public licen[sc]e(?:,? (?:version |v\.? ?)?1\.[01])?"),
    ("epl-2.0", "notice", "eclipse", r"under the terms of the eclipse public license (?:v\.? ?|version )?2\.0"),
    ("epl-1.0", "notice", "eclipse", r"under the terms of the eclipse public license (?:v\.? ?|version )?1\.0"),
    ("epl", "tag", "eclipse", r"eclipse\.org/legal/epl-(?:v10|2\.0)"),
    ("epl", "name", "eclipse", r"\beclipse public licen[sc]e(?:,? (?:version |v\.? ?)?[12]\.0)?"),
    ("edl", "name", "eclipse", r"\beclipse distribution licen[sc]e(?:,? (?:version |v\.? ?)?1\.0)?"),
    ("cddl", "notice", "development", r"the contents of this file are subject to the terms of (?:either )?the common development and distribution license"),
    ("cddl", "name", "development", r"\bcommon development and distribution licen[sc]e(?:,? (?:version |v\.? ?)?1\.[01])?"),
    ("cpl-1.0", "name", "common", r"\bcommon public licen[sc]e(?:,? (?:version |v\.? ?)?1\.0)?"),
    ("cpal", "name", "attribution", r"\bcommon public attribution licen[sc]e(?:,? (?:version |v\.? ?)?1\.0)?"),
    ("eupl", "notice", "european", r"licensed under the eupl,? (?:version |v\.? ?)?1\.[12].{0,60}european commission"),
    ("eupl", "name", "european", r"\beuropean union public licen[sc]e(?:,? (?:version |v\.? ?)?1\.[12])?"),
    ("osl-3.0", "name", "open", r"\bopen software licen[sc]e(?:,? (?:version |v\.? ?)?3\.0)?"),
    ("afl-3.0", "name", "academic", r"\bacademic free licen[sc]e(?:,? (?:version |v\.? ?)?3\.0)?"),
    ("qpl", "name", "public", r"\bq public licen[sc]e(?:,? (?:version |v\.? ?)?1\.0)?"),
    ("sleepycat", "text", "accompanied", r"redistributions in any form must be accompanied by information on how to obtain complete source code"),
    ("ms-pl", "name", "microsoft", r"\bmicrosoft public licen[sc]e"),
    ("ms-rl", "name", "microsoft", r"\bmicrosoft reciprocal licen[sc]e"),
    ("ibm-pl", "name", "ibm", r"\bibm public licen[sc]e(?:,? (?:version |v\.? ?)?1\.0)?"),
    ("artistic-2.0", "name", "artistic", r"\b(?:the )?artistic licen[sc]e,? ?(?:version |v\.? ?)?2\.0"),
    ("artistic", "notice", "perl", r"under the same terms as perl(?: ?5)?(?: itself)?"),
    ("artistic", "name", "artistic", r"\b(?:the )?(?:clarified )?artistic licen[sc]e"),
    ("lppl", "name", "latex", r"\blatex project public licen[sc]e(?:,? (?:version |v\.? ?)?1\.[0-3][abc]?)?"),
    # permissive ones with texts of their own
    ("zlib", "text", "misrepresented", r"the origin of this software must not be misrepresented;? you must not claim that you wrote the original software"),
    ("zlib", "text", "altered", r"altered source versions must be plainly marked as such,? and must not be misrepresented as being the original software"),
    ("zlib", "text", "warranty", r"this software is provided [\"'‘]?as-is[\"'’]?,? without any express or implied warranty"),
    ("zlib", "name", "zlib", r"\bzlib(?:/libpng)? licen[sc]e"),
    ("libpng", "name", "libpng", r"\blibpng licen[sc]e(?: version 2)?"),
    ("boost", "notice", "boost", r"distributed under the boost software license,? version 1\.0"),
    ("boost", "name", "boost", r"\bboost software licen[sc]e(?:,? ?(?:-|version) ?1\.0)?"),
    ("unlicense", "text", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "text", "anyone", r"anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("unlicense", "name", "unlicen", r"\b(?:the )?unlicen[sc]e\b"),
    ("wtfpl", "text", "public", r"do what the f\w{1,4} you want to public licen[sc]e"),
    ("wtfpl", "name", "wtfpl", r"\bwtfpl\b"),
    ("beerware", "text", "beer", r"if we meet some day,? and you think this stuff is worth it,? you can buy me a beer"),
    ("psf", "name", "python", r"\bpython software foundation licen[sc]e(?:,? version 2)?"),
    ("python-2.0", "text", "python", r"psf hereby grants licensee a nonexclusive, royalty-free, world-wide license.{0,80}python"),
    ("ruby", "notice", "ruby", r"under the same terms as ruby(?: itself)?|\bruby licen[sc]e"),
    ("php-3.01", "notice", "php", r"this source file is subject to version 3\.0[01]? of the php license"),
    ("php", "name", "php", r"\bphp licen[sc]e(?:,? (?:version |v\.? ?)?3\.0[01]?)?"),
    ("zpl", "name", "zope", r"\bzope public licen[sc]e(?:,? ?\(?(?:version |v\.? ?)?2\.[01])?"),
    ("w3c", "name", "w3c", r"\bw3c(?:®)? software (?:and document )?(?:notice and )?licen[sc]e"),
    ("openssl", "text", "openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", "text", "cryptographic", r"this product includes cryptographic software written by eric young"),
    ("openssl", "name", "openssl", r"\bopenssl licen[sc]e"),
    ("curl", "name", "curl", r"\bcurl licen[sc]e"),
    ("postgresql", "name", "postgresql", r"\b(?:the )?postgresql licen[sc]e"),
    ("ncsa", "name", "illinois", r"\b(?:university of )?illinois(?:/ncsa)? open source licen[sc]e"),
    ("unicode", "name", "unicode", r"\bunicode(?:, inc\.)? (?:data files and software )?licen[sc]e(?: agreement)?"),
    ("icu", "name", "icu", r"\bicu licen[sc]e"),
    ("ofl", "notice", "font", r"this font software is licensed under the sil open font license,? version 1\.1"),
    ("ofl", "name", "font", r"\b(?:sil )?open font licen[sc]e(?:,? ?(?:version |v\.? ?)?1\.[01])?"),
    ("bitstream-vera", "name", "vera", r"\bbitstream vera fonts? copyright"),
    ("odbl", "name", "database", r"\b(?:odc )?open database licen[sc]e(?: ?\(odbl\))?(?: v?1\.0)?"),
    ("odc-by", "name", "data", r"\bopen data commons attribution licen[sc]e(?: v?1\.0)?"),
    ("pddl", "name", "dedication", r"\bpublic domain dedication and licen[sc]e"),
    ("ogl-uk", "name", "government", r"\bopen government licen[sc]e(?: v[123]\.0)?"),
    ("json", "text", "evil", r"the software shall be used for good, not evil"),
    ("cecill", "name", "cecill", r"\bcecill(?:-[bc])?(?: (?:version |v\.? ?)?[12]\.[01])?(?: (?:free software )?licen[sc]e)?\b"),
    ("mulan", "name", "mulan", r"\bmulan (?:psl|permissive software licen[sc]e)(?:,? ?v2)?"),
    # source-available and proprietary terms
    ("sspl", "name", "server", r"\bserver side public licen[sc]e(?:,? ?(?:version |v\.? ?)?1)?"),
    ("busl", "name", "business", r"\bbusiness source licen[sc]e(?:,? ?(?:version |v\.? ?)?1\.1)?"),
    ("elastic", "name", "elastic", r"\belastic licen[sc]e(?:,? ?(?:version |v\.? ?)?2\.0)?"),
    ("commons-clause", "name", "commons", r"[\"“]?commons clause[\"”]? licen[sc]e condition"),
    ("polyform", "name", "polyform", r"\bpolyform (?:noncommercial|shield|strict|small business) licen[sc]e"),
    ("openrail", "name", "rail", r"\b(?:creativeml )?open ?rail(?:-m|\+\+-m)?(?: licen[sc]e)?"),
    ("proprietary", "notice", "proprietary", r"(?:this (?:software|document|file) (?:is|contains) )?(?:the )?(?:confidential and proprietary|proprietary and confidential)(?: information)?"),
    ("proprietary", "notice", "unauthori", r"unauthori[sz]ed (?:copying|use|reproduction|distribution|duplication)(?: (?:or|and) (?:copying|use|reproduction|distribution|duplication))? (?:of this (?:file|software|document|material),? (?:via any medium )?)?is strictly prohibited"),
    ("proprietary", "notice", "trade", r"contains (?:valuable )?trade secrets"),
    ("proprietary", "name", "proprietary", r"\bproprietary (?:software )?licen[sc]e"),
    ("eula", "name", "user", r"\bend[ -]user licen[sc]e agreement"),
    ("no-redistribution", "notice", "reproduced", r"no part of this (?:publication|document|work|book|software) may be reproduced(?:,? stored| or transmitted| in any form)?"),
    ("personal-use", "notice", "personal", r"for personal,? (?:and )?non-?commercial use only"),
    ("permission-required", "notice", "permission", r"(?:used|reproduced|reprinted|republished) (?:with|by) (?:kind )?permission of"),
    # dedications, rights and disclaimers
    ("public-domain", "notice", "domain", r"(?:released|placed|dedicated|is) (?:in|into|to) the public domain"),
    ("public-domain", "name", "domain", r"\b(?:in|into|to) the public domain\b"),
    ("reserved", "notice", "reserved", r"copyright (?:\(c\) |© )?(?:19|20)[0-9]{2}[^\n]{0,80}?all[^a-z0-9]{1,20}rights[^a-z0-9]{1,20}reserved"),
    ("reserved", "name", "reserved", r"all[^a-z0-9]{1,20}rights[^a-z0-9]{1,20}reserved"),
    ("reserved", "name", "reserved", r"some[^a-z0-9]{1,20}rights[^a-z0-9]{1,20}reserved"),
    ("copyright", "name", "copyright", r"\bcopyright ?(?:\(c\)|©)? ?(?:19|20)[0-9]{2}(?:[ ,-]+(?:19|20)[0-9]{2}){0,40}"),
    ("copyright", "name", "(c)", r"\(c\) ?(?:19|20)[0-9]{2}(?:[ ,-]+(?:19|20)[0-9]{2}){0,40}"),
    ("copyright", "name", "©", r"© ?(?:19|20)[0-9]{2}(?:[ ,-]+(?:19|20)[0-9]{2}){0,40}"),
    ("warranty", "text", "warranty", r"without warranty of any kind,? (?:either )?express(?:ed)? or implied"),
    ("warranty", "text", "warranty", r"\bwithout warranty of any kind"),
    ("warranty", "text", "warranties", r"without warranties or conditions of any kind"),
    ("warranty", "name", "provided", r"\bprovided [\"“']?as[ -]is[\"”']?"),
]
