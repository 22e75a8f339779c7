"""keymoment: finding and scoring moments in time-stamped multi-modal tables with PySpark."""
