"""Training-data operators. Nothing outside this subpackage imports it.

Common rules of the operators here
----------------------------------
* A null text counts as an empty one; a null key sorts last and forms a group of its own.
* Operators select the columns they need by name and return new frames, so extra columns of an
  input (also such as clash with the operator's own) neither matter nor survive.
* Repeated rows are rows like any other unless an operator says otherwise.
* An empty table gives an empty result with the same columns.
* What has to be cut from its lineage is written as Parquet below the shared folder of
  ``spark.checkpoint.dir`` (see :mod:`webloom.llm.common`), so a lost executor costs a retry only.
"""
