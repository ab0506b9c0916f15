"""python -m gleanworks"""

import sys

from gleanworks.plans.app import main

sys.exit(main())
