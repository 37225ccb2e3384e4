"""Collections and their catalog: the control plane, on the driver, over DataFrames."""
