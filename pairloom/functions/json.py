"""Reading a text as exactly one JSON object."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The JSON reader would otherwise take 'single quoted' text, which is not JSON.
STRICT = {"allowSingleQuotes": "false"}


def single_json(text: Column, schema: T.StructType) -> Column:
    """The text as an object of the schema; null when it is anything but one JSON object.

    ``from_json`` on its own stops after the first value and ignores what follows. So the text is put
    into an array, in front of a last object of our own. Text after the object, or a bracket too many,
    then makes the array wrong, longer, or end before that last object. The name in it is a new one each
    time, so no text can hold it. It takes one pass.
    """
    end = f"end_{uuid.uuid4().hex}"
    with_end = T.StructType([*schema.fields, T.StructField(end, T.BooleanType())])
    items = F.from_json(
        F.concat(F.lit("["), text, F.lit(f',{{"{end}":true}}]')), T.ArrayType(with_end), STRICT
    )

    def first(found: Column) -> Column:
        whole = (F.array_size(found) == 2) & F.get(found, F.lit(1))[end]
        return F.when(whole, F.get(found, F.lit(0)))

    # Bound to a name in a function of one array, so that it is parsed once however often it is used.
    return F.get(F.transform(F.array(items), first), F.lit(0))
