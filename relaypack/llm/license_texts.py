"""Sentences and notices of licence families, and sentences that only sound like them."""

from __future__ import annotations

# What licences and their usual notices say.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "AFL": ("Licensed under the Academic Free License version 3.0", "SPDX-License-Identifier: AFL-3.0", "This Academic Free License applies to any original work of authorship"),
    "AGPL": ("Licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it under the terms of the GNU Affero General Public License", "SPDX-License-Identifier: AGPL-3.0-only", "Released under the AGPL.", "You should have received a copy of the GNU Affero General Public License along with this program"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0", "Released under the Apache 2.0 license.", "This project is available under the Apache License 2.0.", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"),
    "Artistic": ("you can redistribute it and/or modify it under the terms of the Artistic License 2.0", "The Artistic License 2.0", "SPDX-License-Identifier: Artistic-2.0", "Released under the Artistic License."),
    "BSD": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Released under the BSD License.", "SPDX-License-Identifier: BSD-3-Clause", "Licensed under the 3-clause BSD license.", "Use of this source code is governed by a BSD-style license.", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    "BSL": ("Distributed under the Boost Software License, Version 1.0.", "Boost Software License - Version 1.0", "SPDX-License-Identifier: BSL-1.0", "Boost Software License"),
    "BUSL": ("Business Source License 1.1", "Licensed under the Business Source License version 1.1", "SPDX-License-Identifier: BUSL-1.1", "Use of this software is governed by the Business Source License"),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0", "Available under the Creative Commons Attribution License."),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0", "Licensed under CC BY-NC-SA 4.0.", "Released under CC-BY-NC.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    "CC-BY-ND": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "SPDX-License-Identifier: CC-BY-ND-4.0", "Released under CC-BY-ND."),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0", "Text is available under the Creative Commons Attribution-ShareAlike License."),
    "CC0": ("This work is dedicated to the public domain under CC0.", "SPDX-License-Identifier: CC0-1.0", "CC0 1.0 Universal", "The person who associated CC0 with this work has waived all copyright and related or neighboring rights"),
    "CDDL": ("subject to the terms of the Common Development and Distribution License", "SPDX-License-Identifier: CDDL-1.0", "COMMON DEVELOPMENT AND DISTRIBUTION LICENSE (CDDL) Version 1.0", "Released under the CDDL."),
    "CeCILL": ("This software is governed by the CeCILL license under French law and abiding by the rules of distribution of free software.", "SPDX-License-Identifier: CECILL-2.1", "Released under the CeCILL license."),
    "EPL": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "Eclipse Public License - v 2.0", "SPDX-License-Identifier: EPL-2.0", "Released under the Eclipse Public License, Version 1.0.", "Licensed under the EPL."),
    "EUPL": ("Licensed under the EUPL, Version 1.2 or subsequent versions of the EUPL", "European Union Public Licence v. 1.2", "SPDX-License-Identifier: EUPL-1.2", "Released under the European Union Public Licence."),
    "GPL": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License", "SPDX-License-Identifier: GPL-3.0-or-later", "Released under the GPL v2.", "Licensed under the GNU GPL version 2.", "You should have received a copy of the GNU General Public License along with this program", "License: GPLv3"),
    "ISC": ("Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "SPDX-License-Identifier: ISC", "ISC License"),
    "LGPL": ("Licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License", "SPDX-License-Identifier: LGPL-2.1-only", "Released under the LGPL.", "You should have received a copy of the GNU Lesser General Public License along with this library"),
    "LPPL": ("This work may be distributed and/or modified under the conditions of the LaTeX Project Public License", "SPDX-License-Identifier: LPPL-1.3c", "LaTeX Project Public License"),
    "MIT": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "SPDX-License-Identifier: MIT", "Licensed under the MIT license.", "The MIT License (MIT)", "Distributed under the terms of the MIT license."),
    "MPL": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0", "Licensed under the Mozilla Public License 2.0.", "Released under the MPL 2.0.", "Mozilla Public License Version 1.1"),
    "MS-PL": ("Microsoft Public License (Ms-PL)", "Licensed under the Microsoft Public License", "SPDX-License-Identifier: MS-PL"),
    "NCSA": ("University of Illinois/NCSA Open Source License", "SPDX-License-Identifier: NCSA", "Distributed under the University of Illinois Open Source License."),
    "OFL": ("This Font Software is licensed under the SIL Open Font License, Version 1.1.", "SPDX-License-Identifier: OFL-1.1", "SIL OPEN FONT LICENSE Version 1.1"),
    "OSL": ("Licensed under the Open Software License version 3.0", "SPDX-License-Identifier: OSL-3.0", "This Open Software License applies to any original work of authorship"),
    "PSF": ("PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2", "SPDX-License-Identifier: PSF-2.0", "Licensed under the Python Software Foundation License"),
    "PostgreSQL": ("Released under the PostgreSQL License.", "SPDX-License-Identifier: PostgreSQL", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted"),
    "Proprietary": ("All rights reserved.", "Copyright 2020 Example Corp. All rights reserved.", "This software is proprietary and confidential.", "Unauthorized copying of this file is strictly prohibited, proprietary and confidential."),
    "Public-Domain": ("Released into the public domain.", "This file is in the public domain.", "This work has been placed in the public domain by its author."),
    "SSPL": ("Server Side Public License, version 1", "SPDX-License-Identifier: SSPL-1.0", "Licensed under the Server Side Public License"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense", "Released under the Unlicense."),
    "WTFPL": ("Released under the WTFPL.", "SPDX-License-Identifier: WTFPL", "Licensed under the WTFPL version 2"),
    "Zlib": ("Released under the zlib License.", "SPDX-License-Identifier: Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
}

#: Sentences that hold licence words and grant nothing that is known here; families of their own are unknown too.
NEGATIVES = (
    "He renewed his driving license at the public office last week.", "The license plate of the car was found near the river.", "She asked for permission to enter the public garden.", "Students at MIT met in the commons of the building.",
    "The Apache helicopter flew over the valley.", "An Apache web server was installed on the machine.", "The copyright dispute went to court.", "A warranty of two years covers the engine.", "The police had a warrant for the house.", "They are creative people with public support.",
    "The committee will permit no license to operate.", "The table was reserved for two.", "GNU tools were used to build it.", "Mozilla announced a new browser.", "The accident occurred on a public road.", "Redistribution of wealth is a public issue.", "A creative writing course in the house of commons.",
    "The pilot lost the license for a year.", "Confidential sources told the public.", "All seats are reserved for members.", "The restaurant has a liquor license.", "We accept success according to public account.", "A BSD system was running in the lab.", "The licensing board met in public.",
    "Licensed under the Acme Public License version 2.0.", "Released under the Foo Software License.", "This file is licensed under the Nokia Open Source License.", "Licensed under the Example Community License Agreement.", "The IBM Public License, Version 1.0", "Subject to the Sun Public License.", "Released under the Company Open License 1.1.",
    "Available under the Internal Source License.", "Licensed under the Red Team Public License, v. 1.0.", "The Sleepycat License", "The Eclipse of the sun was seen by the public.", "They boost the public mood.", "An artistic license was taken by the painter.", "The Python foundation met in Illinois.", "A PostgreSQL database was installed.",
    "The European Union granted public money.", "A latex glove was found.", "The server side of the public site was down.", "Microsoft showed a public preview.", "The font was open to the public.",
)
