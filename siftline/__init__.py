"""siftline: bulk page auditing and corpus preparation on PySpark."""
