"""Licence wordings as they are printed, from which the SQL text of the licence scan is made.

They are written down apart from the templates of the scan, so that one can be held against the
other. `{n}` stands for one to n words, `(( … ))` may be missing.
"""

from __future__ import annotations

import re

#: Label, score, wording.
TEXTS: tuple[tuple[str, float, str], ...] = (
    ("mit", 1.0, """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files ((the "Software")), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice ((including the next paragraph)) shall be included in all copies
or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL {12} BE LIABLE
FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR
IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("mit", 0.6, """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files ((the "Software")), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions"""),
    ("mit", 0.6, "under the ((terms of the)) MIT License"),
    ("isc", 1.0, """
Permission to use, copy, modify, and((/or)) distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND {12} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL {12} BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE."""),
    ("isc", 0.6, """
Permission to use, copy, modify, and((/or)) distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("bsd-2", 1.0, """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: ((1.)) Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. ((2.)) Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution.
THIS SOFTWARE IS PROVIDED BY {12} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {12} BE
LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND
ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN
ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("bsd-3", 1.0, """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: ((1.)) Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. ((2.)) Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution. ((3.)) Neither the name of {12} nor the names of ((its)) ((any)) contributors may be used to endorse or
promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY {12} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {12} BE
LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND
ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN
ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("bsd", 0.6, """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met"""),
    ("apache-2", 0.8, """
Licensed under the Apache License, Version 2.0 ((the "License")); you may not use this file except in compliance with
the License. You may obtain a copy of the License at {10} Unless required by applicable law or agreed to in writing,
software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
either express or implied. See the License for the specific language governing permissions and limitations under the
License."""),
    ("apache-2", 0.6, "Licensed under the Apache License, Version 2.0"),
    ("gpl", 0.8, """
is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version."""),
    ("lgpl", 0.8, """
is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as
published by the Free Software Foundation, either version {3} of the License, or (at your option) any later version."""),
    ("agpl", 0.8, """
is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as
published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version."""),
    ("gpl", 0.6, "Licensed under the GNU General Public License ((version {2}))"),
    ("gpl", 0.6, "under the terms of the GNU General Public License"),
    ("lgpl", 0.6, "Licensed under the GNU Lesser General Public License ((version {2}))"),
    ("lgpl", 0.6, "under the terms of the GNU Lesser General Public License"),
    ("agpl", 0.6, "Licensed under the GNU Affero General Public License ((version {2}))"),
    ("agpl", 0.6, "under the terms of the GNU Affero General Public License"),
    ("mpl-2", 0.8, """
This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at {8}"""),
    ("mpl-2", 0.6, "under the ((terms of the)) Mozilla Public License ((v.)) ((version)) 2.0"),
    ("cc", 0.6, "licensed under ((a)) Creative Commons {6} license"),
    ("cc-by", 0.6, "licensed under CC BY ((SA)) ((ND)) {1} 0"),
    ("cc-by-nc", 0.6, "licensed under CC BY-NC ((SA)) ((ND)) {1} 0"),
    ("public-domain", 0.6, "released into the public domain"),
    ("all-rights-reserved", 0.6, "All rights reserved"),
)


def patterns() -> list[tuple[str, float, str]]:
    """Label, score and a regular expression over ' word word … ' of each wording."""
    out = []
    for label, score, text in TEXTS:
        tokens = re.findall(r"\(\(|\)\)|\{\d+\}|[a-z0-9]+", text.lower())
        made = {"((": "(?:", "))": ")?"}
        parts = [made.get(t) or (f"(?:[^ ]+ ){{1,{t[1:-1]}}}" if t.startswith("{") else t + " ") for t in tokens]
        out.append((label, score, " " + "".join(parts)))
    return out
