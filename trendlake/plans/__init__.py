

from trendlake.plans import registry  # noqa: F401  all plan modules, in the one order that works
