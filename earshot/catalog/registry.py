"""Name -> query and name -> checking SQL."""

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame``, with the SQL that gives the same table."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        def run(spark, sf_dir):
            from earshot.settings import tune

            return fn(tune(spark), sf_dir)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add
