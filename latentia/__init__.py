"""latentia: item-response analytics and large-corpus preparation on Spark DataFrames."""
