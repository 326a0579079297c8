"""Questions about a code base as Spark plans: policies, rules, the decision pipeline, inventories and reports."""
