from contactloom.sinks.files import (
    run_stamp,
    save,
    update_history,
    with_output_names,
    write_csv,
    write_excel,
    write_json,
)

__all__ = [
    "run_stamp",
    "save",
    "update_history",
    "with_output_names",
    "write_csv",
    "write_excel",
    "write_json",
]
