"""python -m wakeline STAGE ROOT [CONFIG.json]: run one stage, or `all`."""

import json
import sys

from wakeline.config import Config
from wakeline.plans.stages import STAGES
from wakeline.session import get_session


def main(args: list[str]) -> int:
    if len(args) not in (2, 3) or args[0] not in (*STAGES, "all"):
        print(__doc__, "stages:", *STAGES, file=sys.stderr)
        return 2
    config = Config.load(json.loads(open(args[2]).read())) if len(args) == 3 else Config()
    spark = get_session()
    for name in STAGES if args[0] == "all" else [args[0]]:
        STAGES[name](spark, args[1], config)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
