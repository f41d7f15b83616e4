"""refledger: effective-dated reference data, rules and request logs on Spark.

Every public function takes and returns DataFrames or Columns. Nothing is collected to the driver.
"""
