"""Query plans: the registered queries over the driver's tables and the
pipelines that chain the operators."""
