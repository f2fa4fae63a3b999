"""Operations of a training-data pipeline: ten operators over documents, vectors and conversations.

Nothing outside this subpackage imports it.  Shared conventions, unless an operator's docstring says otherwise:

* An operator selects the columns that it needs by name; further columns, whatever they are called, are ignored.
* A null text counts as an empty one.  A null id is an id of its own that sorts after all others.
* Rows that repeat an id with the same text are one document and get the same result on each row.
* Tables that a later step needs are written below ``spark.checkpoint.dir`` (see ``_common.table``), so a lost
  executor costs a re-read and no result depends on an executor's local disk.
"""
