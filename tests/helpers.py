def values(frame, *columns):
    """Rows as tuples, sorted."""
    picked = frame.select(*columns) if columns else frame
    return sorted((tuple(r) for r in picked.collect()), key=repr)


def one_column(frame, column, order="_row_num"):
    return [r[column] for r in frame.orderBy(order).collect()]


def plan_text(frame):
    return frame._jdf.queryExecution().executedPlan().toString()
