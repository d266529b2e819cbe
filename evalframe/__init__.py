"""evalframe: analysis of model-evaluation results as Spark jobs.

Every public function takes and returns DataFrames or Columns; nothing sample-sized reaches the driver.
"""
