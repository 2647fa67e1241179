"""echogrid: coherent imaging-radar analytics on Spark DataFrames."""
